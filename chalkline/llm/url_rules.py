"""URL rules by a sort-merge range join (operator 11).

A host is written with its labels reversed and each followed by a dot (`www.example.com` is `com.example.www.`), so a
rule's host and all its subdomains are one interval of keys, and intervals are nested or disjoint. Urls are dealt by
ranges of that key, continued by path and a hash so that a host of any size is split; a rule goes to every range that
its interval touches. Each task sorts its range and sweeps it once with a stack: a rule is pushed where its interval
begins and popped where it ends, so the stack holds just the rules whose host fits. Paths are looked up among the
prefixes of the rules on the stack.

The longest rule decides, counted in characters of host and path; of equally long ones the longer host, of the same
rule given twice `block`. Without a rule the verdict is `default`: the rules are a filter, so that is `allow`.

Results for odd input: a null url or one without `://` has an empty host and path, and rules with a path do not fit it;
repeated rows and null ids are judged each for itself; rules with a null host or path or another verdict than `allow`
and `block` take no part; a rule with an empty host fits every host; other columns are ignored; an empty table gives
no rows. Memory: a task holds the rules of one chain of nested hosts, never a group of urls. The bounds of the ranges
come from a sample of about `PER_RANGE` keys a range, which affects no result.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.batches import map_arrow
from chalkline.llm.common import random_key

#: Keys sampled for each range to place its bounds, and characters of a path that take part in them.
PER_RANGE, PATH_IN_KEY = 20, 64
#: The character after the dot: no host holds it, and it ends the interval of a reversed host.
AFTER_DOT = "/"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path (up to `?` or `#`); both empty where there is no `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def page_key(host: Column, path: Column, salt: Column) -> Column:
    """Sort key of a url. No host holds a slash, so it begins with a rule's key only if the reversed host does."""
    return F.concat(reversed_host(host), F.lit("/"), F.substring(path, 1, PATH_IN_KEY), F.lit("/"), F.hex(salt))


def _bounds(pages: DataFrame, ranges: int) -> list[str]:
    """Keys that cut the pages into about equal ranges, from a sample by hash of about PER_RANGE keys a range."""
    total = pages.count()
    share = min(1.0, PER_RANGE * ranges / max(1, total))
    place = F.shiftrightunsigned(random_key(11, F.col("salt")), 33)  # 31 bits
    keys = pages.where(place <= int(2**31 * share)).select(page_key(F.col("host"), F.col("path"), F.col("salt")))
    sample = sorted(r[0] for r in keys.limit(2 * PER_RANGE * ranges + 1000).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


class Sweep:
    """Urls and rules in order of their keys; the stack holds the hosts whose interval covers the present key."""

    def __init__(self):
        self.stack: list[tuple[str, int, dict[str, tuple[str, str]], list[int]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, prefix: str, host: str, path: str, verdict: str) -> None:
        self._leave(prefix)
        if not self.stack or self.stack[-1][0] != prefix:
            self.stack.append((prefix, len(host), {}, []))
        _, _, paths, lengths = self.stack[-1]
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)
        if paths.get(path, ("", "allow"))[1] == "allow":
            paths[path] = (host + path, verdict)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        self._leave(key)
        best, found = (-1, -1), None
        for _, host, paths, lengths in self.stack:
            if lengths[0] + host < best[0]:
                continue
            for n in lengths:
                hit = paths.get(path[:n]) if n <= len(path) else None
                if hit:
                    if (host + n, host) > best:
                        best, found = (host + n, host), hit
                    break
        return found


def _sweep_range(default: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep()
        for b in batches:
            ids, rules, verdicts, at = b.column("page_id"), [], [], []
            keys, hosts, paths, given = (b.column(c).to_pylist() for c in ("key", "host", "path", "verdict"))
            for i, key in enumerate(keys):
                if given[i] is not None:
                    state.rule(key, hosts[i], paths[i], given[i])
                    continue
                found = state.judge(key, paths[i])
                at.append(i)
                rules.append(found and found[0])
                verdicts.append(found[1] if found else default)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pick), b.column("host").take(pick), b.column("path").take(pick), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return sweep


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`pages` (id, url) judged by `rules` (host, path, verdict): page_id, host, path, rule, verdict, one row a page."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), random_key(5, F.col(id_col), F.col(url_col)).alias("salt"))
    kind = rows.schema["page_id"].dataType.simpleString()
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows, ranges)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k) for k in keys], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(prefixes: pd.Series) -> pd.Series:
        """Ranges that hold keys beginning with the prefix."""
        last = lambda p: bisect_left(bounds, p[:-1] + AFTER_DOT) if p else len(bounds)
        return pd.Series([list(range(bisect_right(bounds, p), last(p) + 1)) for p in prefixes])

    rule_host = lower_ascii(F.col("host"))
    prefix = F.when(rule_host == "", F.lit("")).otherwise(reversed_host(rule_host))
    given = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
    given = given.select(prefix.alias("key"), rule_host.alias("host"), "path", "verdict")
    given = given.select(F.explode(ranges_of("key")).alias("range"), F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict", F.lit(None).cast("long").alias("salt"))
    own = page_key(F.col("host"), F.col("path"), F.col("salt"))
    urls = rows.select(range_of(own).alias("range"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"), "salt")

    dealt = urls.unionByName(given).repartitionById(len(bounds) + 1, "range")
    key = F.when(F.col("verdict").isNull(), own).when(F.col("host") == "", F.lit("")).otherwise(reversed_host(F.col("host")))
    ordered = dealt.select(key.alias("key"), "page_id", "host", "path", "verdict").sortWithinPartitions("key", F.col("verdict").asc_nulls_last())
    return map_arrow(ordered, _sweep_range(default), f"page_id {kind}, host string, path string, rule string, verdict string")
