"""Temporal URL filtering: dated list entries as validity intervals, joined to captures as of their fetch time.

A list is a log of dated entries (pattern, action, at): ``block`` puts a pattern on the list, ``allow`` takes it off.
Each pattern's entries become validity intervals [valid_from, valid_to): from a block to the next allow of the same
pattern. A pattern is a host, which also covers its sub-domains, or host/path, which covers that path and what lies
below it on exactly that host. Every capture is turned into its keys (host, parent domains, host with path prefixes as deep
as the deepest pattern), and an as-of join evaluates each key against the interval that holds the fetch time.

A bitmap filter over the patterns drops keys that no entry has before anything is shuffled. Intervals are broadcast only
below a measured size; beyond it, and for repeated captures, a key that very many rows have is dealt over many tasks.

Defined results: a null or unparseable URL, or a null fetch time, matches nothing (blocked = false); entries with a
null pattern, action or date are ignored; of entries of one pattern and one date, block wins; the fetch time equal
to valid_from is covered, equal to valid_to is not; repeated captures get the same answer each; an empty list blocks
nothing; very long URLs are read whole; columns of the input that are called as those that are added are replaced, all
others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BitFilter, hot_keys, materialize, salted_join

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def canonical(pattern: Column) -> Column:
    """host or host/segment/segment, the host in lower case."""
    parts = _segments(pattern)
    return F.concat_ws("/", F.concat(F.array(F.lower(F.get(parts, F.lit(0)))), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) of a list's log; valid_to is null while the entry stands."""
    log = entries.where("pattern IS NOT NULL AND action IN ('block', 'allow') AND at IS NOT NULL").where(F.size(_segments(F.col("pattern"))) > 0)
    log = log.select(canonical(F.col("pattern")).alias("pattern"), F.col("at"), (F.col("action") == "block").alias("on"))
    log = log.groupBy("pattern", "at").agg(F.max("on").alias("on"))
    w = Window.partitionBy("pattern").orderBy("at")
    # only changes of state stay, so the next row of a block is the allow that ends it
    changes = log.withColumn("was", F.lag("on", 1, False).over(w)).where("on != was")
    return changes.withColumn("valid_to", F.lead("at").over(w)).where("on").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def _keys(url: Column, depth: int) -> Column:
    """Every key of a URL that a pattern of at most ``depth`` path segments can equal."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n - i + 1)))
    parts = _segments(F.regexp_extract(url, PATH, 1))
    reach = F.least(F.size(parts), F.lit(depth))
    paths = F.transform(
        F.when(reach > 0, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws("/", F.concat(F.array(h), F.slice(parts, F.lit(1), i)))
    )
    return F.when((h != "") & url.isNotNull(), F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with blocked, matched_pattern (the longest, then first in order), valid_from and n_matches."""
    added = ["blocked", "matched_pattern", "valid_from", "n_matches"]
    cols = [c for c in captures.columns if c not in added]
    intervals, _ = materialize(validity_intervals(entries), "intervals")
    depth, n, n_rows, size = intervals.select(F.max(F.size(F.split("pattern", "/"))) - 1, F.count_distinct("pattern"), F.count("*"), F.sum(F.length("pattern") + 40)).first()
    left = captures.select(*cols)
    if not n:
        return left.select(*cols, F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("matched_pattern"), F.lit(None).cast(intervals.schema["valid_from"].dataType).alias("valid_from"), F.lit(0).cast("long").alias("n_matches"))
    # one probe per distinct (URL, time): copies of a capture are answered once
    asked = left.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_at")).where("_url IS NOT NULL AND _at IS NOT NULL").groupBy("_url", "_at").agg(F.count("*").alias("c"))
    asked, _ = materialize(asked, "asked")
    n_captures = asked.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    probes = asked.select("_url", "_at", F.explode(_keys(F.col("_url"), depth)).alias("_key"))
    members = BitFilter(intervals.select(F.xxhash64("pattern").alias("h")), "h", n)
    probes = members.keep(probes, F.xxhash64("_key"))
    valid = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    if 4 * size <= BROADCAST_BYTES:
        hits = probes.join(F.broadcast(intervals), F.col("_key") == F.col("pattern")).where(valid)
    else:
        # a host that very many captures have is dealt over many tasks, its intervals (one row a pattern) with it
        listed = intervals.groupBy(F.col("pattern").alias("_key")).agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("_spans"))
        probes, _ = materialize(probes, "probes")
        hot = hot_keys(probes.groupBy("_key").agg(F.count("*").alias("c")), ["_key"], probes.count())
        hits = salted_join(probes, listed, ["_key"], hot, ["_url", "_at"]).select("_url", "_at", F.col("_key").alias("pattern"), F.inline("_spans")).where(valid)
    best = hits.groupBy("_url", "_at").agg(
        F.min(F.struct((-F.length("pattern")).alias("o"), "pattern", "valid_from")).alias("_m"), F.count("*").alias("n")
    )
    # The captures' own columns travel as one, so that no name of theirs can clash. Captures without a URL or a time meet
    # nothing; a number in the URL's place keeps them from being dealt to one task.
    at = F.monotonically_increasing_id()
    row = left.select(F.struct(*cols).alias("_row"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"), at.alias("_n"))
    row = row.withColumn("_url", F.when(F.col("_url").isNull() | F.col("_at").isNull(), F.concat(F.lit("\0"), F.col("_n").cast("string"))).otherwise(F.col("_url")))
    out = salted_join(row, best, ["_url", "_at"], hot_keys(asked, ["_url", "_at"], n_captures), ["_n"], "left")
    return out.select(
        *[F.col("_row")[c].alias(c) for c in cols], F.col("_m").isNotNull().alias("blocked"), F.col("_m.pattern").alias("matched_pattern"), F.col("_m.valid_from").alias("valid_from"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_matches"),
    )
