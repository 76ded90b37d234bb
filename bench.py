"""Run the headline queries and print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chalkline.plans import registry  # noqa: E402
from chalkline.plans.registry import queries  # noqa: E402
from chalkline.plans.star import STAGED  # noqa: E402
from chalkline.session import local_session  # noqa: E402

HEADLINE = [
    "marks_latest", "marks_components", "academics_by_year", "academics_avg_of_ratios", "attendance_present",
    "subject_performance", "science_backfill", "achievements_lifetime", "homework_engagement", "master_profile",
    "subject_strengths", "ai_profile", "child_selector", "academic_trend", "career_confidence", "verify_by_year",
    "student_profile", "subject_vs_class", "exam_report", "class_kpis", "class_zones", "signal_distribution",
    "top_performers", "class_subject_marks", "remedial", "careers_first_match", "achievement_categories",
    "career_report", "insight_context", "eca_apply_changes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, "bench")
    known = queries()
    known["attendance_present"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up, not counted
    # Shared tables are written first and timed apart, so that each query's time is its own.
    star, start = registry._star(spark, folder), time.time()
    for table in STAGED:
        getattr(star, table)
    staging = round(time.time() - start, 3)
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        # All columns are produced and thrown away; counting would let Spark skip work.
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "school_queries_total", "value": round(staging + sum(seconds.values()), 3), "unit": "sec", "staging": staging,
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    star.drop()
    spark.stop()


if __name__ == "__main__":
    main()
