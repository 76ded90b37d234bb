"""School tables derived from the order tables.

The given data has no school records, so customers stand for students, orders for student
years, line items for marks, attendance days and homework comments, suppliers for teachers and
parts for subjects in use.  ``y + 24`` moves the order years 1995-2001 onto 2019-2020 … 2025-2026.
Every row of every given table takes part; nothing is sampled. Of records, those of unspecified
priority are left alone by the change batch, and new ones are not stored yet.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions import fixed_values as fv
from chalkline.functions.columns import DEALT
from chalkline.schemas import INPUT_TABLES

SCHOOLS = [(1, "School A", "A", True), (7, "School B", "B", True), (9, "School C", "C", False)]
SUBJECT_NAMES = [
    "English", "Hindi", "Marathi", "Sanskrit", "Mathematics", "Computer Science", "History", "Geography",
    "Economics", "Political Science", "Music", "Dance", "Art & Drawing", "Physical Education", "Physics",
    "Chemistry", "Biology", "Library", "test", "Robotics",
]
HEADINGS = ["Written", "Oral", "Practical", "Activity", "Term", "Portfolio", "Reading"]
EXAMS = ["Term 1", "Periodic Test 2 (IX n X)", "Periodic Test 2"]
SECTIONS = ["A", "B", "C", "D"]
GOALS = ["Doctor", "Software Engineer", "Unknown goal", "Lawyer", "Architecture", "Pilot", "law & governance"]
# Every other event word of the rules, so that most categories and skills occur, and one that no rule knows.
EVENTS = [rule[0].title() for rule in fv.ACHIEVEMENT_CATEGORIES[::2]] + ["Yoga"]
FIRST_ORDER_YEAR, LAST_ORDER_YEAR = 1995, 2001


def _pick(names: list[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), place)


def _school_of(nation: Column) -> Column:
    return F.when(nation < 13, 1).otherwise(7)


def _academic_year(y: Column) -> Column:
    return F.concat((y + 24).cast("string"), F.lit("-"), (y + 25).cast("string"))


class OrderSchool(Mapping[str, DataFrame]):
    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None):
        """``parts``: how many tasks the marks are dealt to; the session's shuffle partitions by default."""
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in INPUT_TABLES:
            raise KeyError(table)
        return self._get(table)

    def __iter__(self) -> Iterator[str]:
        return iter(INPUT_TABLES)

    def __len__(self) -> int:
        return len(INPUT_TABLES)

    def _get(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = getattr(self, f"_{name}")()
        return self._frames[name]

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- joins shared by several tables: customers first, so line items move once --------

    def _owned_orders(self) -> DataFrame:
        orders = self.given("orders").withColumn("y", F.year("o_orderdate"))
        owner = self.given("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey", _school_of(F.col("c_nationkey")).alias("school_id")
        )
        return orders.join(owner, "o_custkey").withColumn("academic_yr", _academic_year(F.col("y")))

    def _lines(self) -> DataFrame:
        orders = self._get("owned_orders").withColumnRenamed("o_orderkey", "l_orderkey")
        return self.given("lineitem").join(orders, "l_orderkey").withColumnRenamed("o_custkey", "student_id")

    # --- people ---------------------------------------------------------------------------

    def _school(self) -> DataFrame:
        # As values of a plan and not as rows handed over, so that their size is known and joins with them are broadcast.
        schema = T.StructType.fromDDL(INPUT_TABLES["school"])
        named = [F.struct(*[F.lit(v).alias(n) for n, v in zip(schema.names, school, strict=True)]) for school in SCHOOLS]
        return self.spark.range(1).select(F.inline(F.array(*named))).to(schema)

    def _student(self) -> DataFrame:
        years = self.given("orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
        owner = self.given("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        k, y = F.col("o_custkey"), F.col("y")
        name = (
            F.when(k % 50 == 1, F.lit("12345"))
            .when(k % 3 == 0, F.concat(F.lit(" Stu"), (k % 2).cast("string"), F.lit(" ")))
            .otherwise(F.concat(F.lit("Stu"), (k % 2).cast("string"), F.lit(" Fam"), k.cast("string")))
        )
        parent = k - k % 2
        return years.join(owner, "o_custkey").select(
            _school_of(F.col("c_nationkey")).alias("school_id"),
            k.alias("student_id"),
            _academic_year(y).alias("academic_yr"),
            name.alias("student_name"),
            F.concat(F.lit("R"), k.cast("string")).alias("reg_no"),
            F.when(k % 2 == 0, "M").otherwise("F").alias("gender"),
            F.when(k % 11 == 0, "0000-00-00").otherwise("2010-06-15").alias("dob"),
            ((k + y) % 12 + 1).cast("int").alias("class_id"),
            (F.col("c_nationkey") % 4 + 1).cast("int").alias("section_id"),
            F.lit("Indian").alias("nationality"),
            F.when(k % 3 == 0, "GEN").when(k % 3 == 1, "OBC").otherwise("SC").alias("category"),
            F.when(k % 97 != 0, parent).alias("parent_id"),
            F.concat(F.lit("Guardian"), parent.cast("string")).alias("guardian_name"),
            F.when(k % 4 != 0, F.concat(F.lit("9"), k.cast("string"))).alias("guardian_mobile"),
            F.when(k % 29 == 0, "Y").otherwise("N").alias("is_delete"),
            F.when(k % 7 == 0, "N").otherwise("Y").alias("is_active"),
        )

    def _parent_keys(self) -> DataFrame:
        return self.given("customer").select(
            _school_of(F.col("c_nationkey")).alias("school_id"),
            (F.col("c_custkey") - F.col("c_custkey") % 2).alias("parent_id"),
        ).distinct()

    def _parent(self) -> DataFrame:
        p = F.col("parent_id")
        text = p.cast("string")
        father = (
            F.when(p % 5 == 0, F.lit(None).cast("string"))
            .when(p % 7 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("Father"), text, F.lit(" Fam")))
        )
        return self._get("parent_keys").select(
            "school_id", "parent_id",
            father.alias("father_name"),
            F.concat(F.lit("Mother"), text).alias("mother_name"),
            F.concat(F.lit("7"), text).alias("f_mobile"),
            F.concat(F.lit("8"), text).alias("m_mobile"),
            F.when(p % 31 == 0, "Y").otherwise("N").alias("is_delete"),
        )

    def _name_aliases(self) -> DataFrame:
        return self._get("parent_keys").filter(F.col("parent_id") % 10 == 0).select(
            "school_id", "parent_id", F.lit("Stu1").alias("raw_name"), F.lit("Stu0").alias("canonical")
        )

    def _teacher(self) -> DataFrame:
        k = F.col("s_suppkey")
        designation = _pick(["Vice Principal", "TGT Maths", "PGT Physics", "PRT", "Clerk"], (k % 5 + 1).cast("int"))
        return self.given("supplier").select(
            _school_of(F.col("s_nationkey")).alias("school_id"),
            k.alias("teacher_id"),
            F.col("s_name").alias("name"),
            designation.alias("designation"),
            (k % 12 + 1).cast("int").alias("class_id"),
            (F.col("s_nationkey") % 4 + 1).cast("int").alias("section_id"),
            F.when(k % 13 == 0, "Y").otherwise("N").alias("is_delete"),
        )

    def _user_master(self) -> DataFrame:
        c, s = F.col("c_custkey"), F.col("s_suppkey")
        parents = self.given("customer").select(
            _school_of(F.col("c_nationkey")).alias("school_id"),
            F.concat(F.lit("P"), c.cast("string")).alias("user_id"),
            F.col("c_name").alias("name"),
            (c - c % 2).alias("reg_id"),
            F.when(c % 17 == 0, "X").otherwise("P").alias("role_id"),
            F.lit("N").alias("is_delete"),
        )
        staff = self.given("supplier").select(
            _school_of(F.col("s_nationkey")).alias("school_id"),
            F.concat(F.lit("t"), s.cast("string")).alias("user_id"),
            F.col("s_name").alias("name"),
            s.alias("reg_id"),
            F.when(s % 5 == 0, "M").otherwise("T").alias("role_id"),
            F.lit("N").alias("is_delete"),
        )
        return parents.unionByName(staff)

    # --- dimensions: fixed size per school --------------------------------------------------

    def _per_school(self) -> DataFrame:
        ids = [s[0] for s in SCHOOLS if s[3]]
        return self.spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("school_id"))

    def _per_school_year(self) -> DataFrame:
        years = F.sequence(F.lit(FIRST_ORDER_YEAR), F.lit(LAST_ORDER_YEAR))
        return self._get("per_school").select("school_id", F.explode(years).alias("y")).select(
            "school_id", _academic_year(F.col("y")).alias("academic_yr")
        )

    def _class(self) -> DataFrame:
        ids = F.explode(F.sequence(F.lit(1), F.lit(12)))
        return self._get("per_school_year").select("school_id", ids.alias("class_id"), "academic_yr").withColumn(
            "name", F.col("class_id").cast("string")
        )

    def _section(self) -> DataFrame:
        return self._numbered(SECTIONS, "section_id")

    def _subject_master(self) -> DataFrame:
        sm = F.col("sm_id")
        kind = F.when(sm.between(11, 14), "Co-Scholastic").when(sm == 18, "Social").otherwise("Scholastic")
        return self._numbered(SUBJECT_NAMES, "sm_id").withColumn("subject_type", kind)

    def _subject(self) -> DataFrame:
        ids = F.explode(F.sequence(F.lit(1), F.lit(len(SUBJECT_NAMES))))
        return (
            self._get("class").select("school_id", ids.alias("sm_id"), "class_id", "academic_yr")
            .filter((F.col("sm_id") + F.col("class_id")) % 7 != 0)
        )

    def _marks_headings(self) -> DataFrame:
        return self._numbered(HEADINGS, "marks_headings_id").select(
            "school_id", "marks_headings_id", "name",
            F.when(F.col("name").isin("Written", "Term"), "Y").otherwise("N").alias("written_exam"),
            F.col("marks_headings_id").alias("sequence"),
        )

    def _exam(self) -> DataFrame:
        named = F.posexplode(F.array(*[F.lit(n) for n in EXAMS])).alias("i", "name")
        return self._get("per_school_year").select("school_id", "academic_yr", named).select(
            "school_id", (F.col("i") + 1).alias("exam_id"), "academic_yr", "name"
        )

    def _numbered(self, names: list[str], key: str) -> DataFrame:
        named = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "name")
        return self._get("per_school").select("school_id", named).select("school_id", (F.col("i") + 1).alias(key), "name")

    # --- marks --------------------------------------------------------------------------------

    def _mark_groups(self) -> DataFrame:
        """One row per revision of a student's subject in an exam, with one column pair per heading.

        Only numbers are aggregated, which keeps the hash aggregation. Hardly any lines fall together, so they are dealt as
        they are, by student-year: groups are wider than lines, and what is grouped lies as a staged table needs it.
        """
        headings = range(1, len(HEADINGS) + 1)
        line = F.col("l_linenumber")
        # Which headings have a line, and which an absent one, are bits: two numbers and not one a heading.
        bit = F.when(line.isin(list(headings)), F.expr("shiftleft(1, cast(l_linenumber AS int))"))
        by_heading = [
            F.bit_or(bit).alias("seen"), F.bit_or(F.when(F.col("l_returnflag") == "R", bit)).alias("absent"),
            *[F.max(F.when(line == h, F.col("l_quantity"))).alias(f"mark_{h}") for h in headings],
        ]

        def has(bits: str, h: int) -> Column:
            return F.coalesce(F.col(bits).bitwiseAND(F.lit(1 << h)), F.lit(0)) != 0

        lines = self._get("lines").select(
            "school_id", "student_id", "y", "academic_yr", "c_nationkey", "l_linenumber", "l_quantity",
            "l_returnflag", "l_shipdate",
            (F.col("l_partkey") % 20 + 1).cast("int").alias("subject"),
            (F.col("l_suppkey") % 3 + 1).cast("int").alias("exam_id"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("rev"),
        )
        parts = self.parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (
            lines.repartition(parts, *DEALT)
            .groupBy("school_id", "student_id", "y", "academic_yr", "c_nationkey", "subject", "exam_id", "rev")
            .agg(F.max("l_shipdate").cast("date").alias("exam_date"), *by_heading)
            .withColumn(
                "marks_id",
                (((F.col("student_id") * 8 + F.col("y") - 1995) * 32 + F.col("subject")) * 8 + F.col("exam_id")) * 2
                + F.col("rev"),
            )
            .withColumns({f"absent_{h}": F.when(has("seen", h), F.when(has("absent", h), 1).otherwise(0)) for h in headings})
            .drop("seen", "absent")
        )

    def _student_marks(self) -> DataFrame:
        def as_json(value_of) -> Column:
            """An object of the headings that have a value; whole numbers and letters need no escapes."""
            cells = [F.concat(F.lit(f'"{h}":"'), value_of(h), F.lit('"')) for h in range(1, len(HEADINGS) + 1)]
            return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))

        return self._get("mark_groups").select(
            "school_id", "marks_id",
            ((F.col("student_id") + F.col("y")) % 12 + 1).cast("int").alias("class_id"),
            (F.col("c_nationkey") % 4 + 1).cast("int").alias("section_id"),
            "exam_id", F.col("subject").cast("string").alias("subject_id"), "student_id", "exam_date",
            as_json(lambda h: F.when(F.col(f"absent_{h}") == 1, "N").when(F.col(f"absent_{h}") == 0, "Y")).alias("present"),
            as_json(lambda h: F.col(f"mark_{h}").cast("int").cast("string")).alias("mark_obtained"),
            as_json(lambda h: F.when(F.col(f"mark_{h}").isNotNull(), "50")).alias("highest_marks"),
            F.when(F.col("subject") % 10 == 9, "N").otherwise("Y").alias("publish"),
            "academic_yr",
        )

    def _mark_rows(self) -> DataFrame:
        cells = F.array(*[
            F.struct(F.lit(h).alias("heading"), F.col(f"mark_{h}").alias("mark"), F.col(f"absent_{h}").alias("absent"))
            for h in range(1, len(HEADINGS) + 1)
        ])
        return (
            self._get("mark_groups")
            .select("school_id", "student_id", "academic_yr", "subject", "exam_id", "marks_id", F.explode(cells).alias("cell"))
            .filter(F.col("cell.mark").isNotNull())
            .withColumn("mark_id", F.col("marks_id") * 8 + F.col("cell.heading"))
        )

    def _mark_master(self) -> DataFrame:
        return self._get("mark_rows").select(
            "school_id", "mark_id", "exam_id", F.col("subject").alias("subject_id"),
            F.col("cell.heading").alias("marks_headings_id"), "academic_yr",
        )

    def _mark_detail(self) -> DataFrame:
        return self._get("mark_rows").select(
            "school_id", "mark_id", "student_id",
            F.when(F.col("cell.absent") == 1, "N").otherwise("Y").alias("present"),
            F.col("cell.mark").cast("int").cast("decimal(5,2)").alias("marks_obtained"),
            F.lit(50).cast("decimal(5,2)").alias("highest_marks"),
        )

    # --- daily records ----------------------------------------------------------------------------

    def _attendance_clean(self) -> DataFrame:
        d = F.col("l_discount")
        return self._get("lines").select(
            "school_id", "student_id", "academic_yr",
            F.col("l_shipdate").cast("date").alias("attendance_date"),
            F.when(d >= 0.10, "A").when(d >= 0.09, "L").otherwise("P").alias("attendance_status"),
        )

    def _achievements_clean(self) -> DataFrame:
        k = F.col("o_orderkey")
        event = _pick(EVENTS, (k % len(EVENTS) + 1).cast("int"))
        return self._get("owned_orders").select(
            "school_id", F.col("o_custkey").alias("student_id"), "academic_yr", event.alias("event"),
            F.when(k % 2 != 0, F.concat(event, F.lit(" Cup"))).alias("achievement"),
            F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "").otherwise("First").alias("position"),
            F.col("o_orderdate").cast("date").alias("date"), k.alias("achievement_id"),
        )

    def _homework(self) -> DataFrame:
        return self._get("owned_orders").select("school_id", F.col("o_orderkey").alias("homework_id"), "academic_yr")

    def _homework_comments(self) -> DataFrame:
        return self._get("lines").select(
            "school_id", F.col("l_orderkey").alias("homework_id"), "student_id"
        )

    # --- extracurricular records --------------------------------------------------------------------

    def _records(self, orders: DataFrame, *extra: Column) -> DataFrame:
        k = F.col("o_orderkey")
        return orders.select(
            "school_id", *extra, k.alias("id"), F.col("o_custkey").alias("student_id"),
            F.col("o_orderpriority").alias("title"), F.lit("Sports").alias("category"),
            F.col("o_orderdate").cast("date").alias("achievement_date"), F.lit("School").alias("level"),
            F.when(k % 3 == 2, "First").alias("position"), F.lit(None).cast("string").alias("description"),
            F.when(k % 2 == 0, "a.png").alias("certificate_filename"),
            F.when(k % 2 == 0, "QUJD").alias("certificate_data"),
            F.when(k % 2 == 0, "image/png").alias("certificate_mime"),
            (F.col("o_custkey") - F.col("o_custkey") % 2).alias("submitted_by_parent_id"),
        )

    def _extracurricular_achievements(self) -> DataFrame:
        kept = (F.col("o_orderstatus") != "O") & (F.col("o_orderpriority") != "5-LOW")
        return self._records(self._get("owned_orders").filter(kept))

    def _eca_changes(self) -> DataFrame:
        orders = self._get("owned_orders").filter(F.col("o_orderpriority") != "4-NOT SPECIFIED")
        priority = F.col("o_orderpriority")
        op = F.when(F.col("o_orderstatus") == "O", "insert").when(priority == "2-HIGH", "delete").otherwise("update")
        first = self._records(orders, F.lit(1).alias("seq"), op.alias("op"))
        i = F.col("id")
        first = first.withColumns({
            "title": F.when(i % 7 != 0, F.concat(F.lit("New "), F.col("title"))),
            "certificate_filename": F.when(i % 3 != 0, "b.png"),
            "certificate_data": F.when(i % 3 != 0, "REVG"),
            "certificate_mime": F.when(i % 3 != 0, "image/png"),
        })
        later = self._records(orders.filter(priority == "1-URGENT"), F.lit(2).alias("seq"), F.lit("delete").alias("op"))
        return first.unionByName(later)

    # --- career goals: one per customer, for the analysis queries -------------------------------------

    def goals(self) -> DataFrame:
        return self.given("customer").select(
            _school_of(F.col("c_nationkey")).alias("school_id"),
            F.col("c_custkey").alias("student_id"),
            _pick(GOALS, (F.col("c_custkey") % len(GOALS) + 1).cast("int")).alias("career_goal"),
        )
