"""Exact document deduplication by a log-structured merge index of text digests (DataFrame functions only).

Every document is logged once as (id, digest, 64-bit key of the digest). A batch's log is cut into memtables in order of
arrival, and each is flushed as a run: one row a digest, sorted by digest, with the smallest and the largest identifier
and the number of rows, and a bitmap filter over the run's keys. Compaction probes every run's rows against the filters
of all other runs: a digest that no other run's filter has is final and only copied, the others are merged by digest.
A digest seen more than once is a hit; the texts of hits, selected through a filter over them, are compared byte by
byte (the smallest and the largest text of a digest must be equal). Digests whose texts differ are split by their text,
so a digest collision never merges two documents.

Defined results: a null text counts as empty; rows that repeat an identifier are separate members of their group and
get the same answer; a null identifier is never a keeper unless all of its group are null (then the keeper is null); of
rows that repeat a keeper's identifier and text, ``drop_exact_copies`` leaves any one; an empty table gives an empty
result; other columns of the input are not looked at, and stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BitFilter, checked_broadcast, drop_path, hot_keys, materialize, salted_join


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class RunFilters:
    """The bitmaps of several runs over one number of bits: per slot an array of (run, bitmap). No false negatives."""

    SLOT_BITS, KEY_BITS = BitFilter.SLOT_BITS, 16

    def __init__(self, runs: DataFrame, most_keys: int):
        """runs: run, key; most_keys: keys of the largest run."""
        self.bits = 1 << max(self.SLOT_BITS, self.KEY_BITS * most_keys).bit_length()
        bit = F.pmod(F.col("key"), F.lit(self.bits))
        made = runs.select("run", bit.alias("b")).groupBy("run", (F.col("b") / self.SLOT_BITS).cast("long").alias("slot")).agg(
            F.expr(f"bitmap_construct_agg(CAST(b % {self.SLOT_BITS} AS BIGINT))").alias("bitmap")
        )
        self.slots, self.path = materialize(made.groupBy("slot").agg(F.collect_list(F.struct("run", "bitmap")).alias("maps")), "filters")

    def may_be_elsewhere(self, rows: DataFrame, n_runs: int) -> DataFrame:
        """rows (with run and key) and _found: whether a filter of another run has the key."""
        slots = checked_broadcast(self.slots, n_runs * (self.bits // self.SLOT_BITS), self.SLOT_BITS // 8)
        probed = rows.withColumn("_b", F.pmod("key", F.lit(self.bits))).withColumn("slot", (F.col("_b") / self.SLOT_BITS).cast("long"))
        byte = F.expr(f"CAST((_b % {self.SLOT_BITS}) DIV 8 AS INT) + 1")

        def has(m: Column) -> Column:
            value = F.conv(F.hex(F.substring(m["bitmap"], byte, F.lit(1))), 16, 10).cast("int")
            return (m["run"] != F.col("run")) & (F.call_function("shiftright", value, F.expr("CAST(_b % 8 AS INT)")) % 2 == 1)

        return probed.join(slots, "slot", "left").withColumn("_found", F.coalesce(F.exists("maps", has), F.lit(False))).drop("slot", "maps", "_b")


class DigestIndex:
    """LSM index over text digests.

    memtables: runs that one ingested batch is flushed to; fanout: batches at which ``add`` compacts.
    digest: Column -> binary Column; SHA-256 unless a test asks for collisions.
    """

    def __init__(self, memtables: int = 4, fanout: int = 8, digest=sha256):
        self.memtables, self.fanout, self.digest = memtables, fanout, digest
        self.runs: list[tuple[DataFrame, str, RunFilters]] = []
        self.n_runs = 0
        self.logs: list[DataFrame] = []
        self.batches: list[DataFrame] = []

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
        """Log a batch and flush its memtables as sorted runs."""
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.batches.append(rows)
        log = rows.select("id", self.digest(F.col("text")).alias("digest"), (F.spark_partition_id() % self.memtables + self.n_runs).alias("run"))
        log, _ = materialize(log.withColumn("key", F.xxhash64("digest")), "log")
        self.logs.append(log)
        run = log.groupBy("run", "digest").agg(F.first("key").alias("key"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n"))
        self._flush(run, self.memtables)
        if len(self.runs) >= self.fanout:
            self.compact()
        return self

    def _flush(self, run: DataFrame, n: int) -> None:
        """Write runs sorted by digest, and their filters."""
        made, path = materialize(run.sortWithinPartitions("run", "digest"), "run")
        most = made.groupBy("run").count().agg(F.max("count")).first()[0] or 0
        self.runs.append((made, path, RunFilters(made, most)))
        self.n_runs += n

    def compact(self) -> DataFrame:
        """Merge all runs into one: per digest the smallest and the largest identifier and the number of rows."""
        if len(self.runs) == 1 and self.runs[0][0].agg(F.count_distinct("run")).first()[0] < 2:
            return self.runs[0][0]
        rows = _union([made for made, *_ in self.runs]).withColumn("_elsewhere", F.lit(False))
        for _, _, filters in self.runs:
            rows = filters.may_be_elsewhere(rows, self.n_runs).withColumn("_elsewhere", F.col("_elsewhere") | F.col("_found")).drop("_found")
        final = rows.where("NOT _elsewhere").select("digest", "key", "min_id", "max_id", "n")
        merged = rows.where("_elsewhere").groupBy("digest").agg(
            F.first("key").alias("key"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n")
        )
        old, self.runs = self.runs, []
        self._flush(final.unionByName(merged).withColumn("run", F.lit(self.n_runs)), 1)
        for _, path, filters in old:
            drop_path(final.sparkSession, path)
            drop_path(final.sparkSession, filters.path)
        return self.runs[0][0]

    def _candidates(self, n_hits: int, hits: DataFrame) -> DataFrame:
        """(id, text, digest) of every row whose digest may be that of a hit."""
        seen = BitFilter(hits, "key", n_hits)
        return _union([seen.keep(b.withColumn("digest", self.digest(F.col("text"))), F.xxhash64("digest")) for b in self.batches])

    def verify(self) -> tuple[DataFrame, int, int, DataFrame | None]:
        """The hits (digest, min_id, max_id, n, same: are all texts equal?), their number, the rows of all of them, and for
        digests of several texts the same by digest and text (None if there are none)."""
        entries = self.compact()
        hits = entries.where("n > 1")
        n_hits, n_rows = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_hits:
            return hits.select("digest", "min_id", "max_id", "n", F.lit(True).alias("same")), 0, 0, None
        candidates = self._candidates(n_hits, hits)
        # Both aggregates combine before the shuffle: a hot group sends one text per task.
        checked = candidates.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
        verified, _ = materialize(hits.join(checked, "digest").select("digest", "min_id", "max_id", "n", "same"), "verified")
        bad = verified.where("NOT same")
        n_bad, bad_rows = bad.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_bad:
            return verified, n_hits, n_rows, None
        numbered = candidates.withColumn("_n", F.monotonically_increasing_id())
        clash = salted_join(numbered, bad.select("digest"), ["digest"], hot_keys(bad, ["digest"], bad_rows, "n"), ["_n"]).drop("_n")
        split = clash.groupBy("digest", "text").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n"))
        return verified, n_hits, n_rows, materialize(split, "split")[0]

    def joined(self, rows: DataFrame, verified: DataFrame, n_hits: int, n_rows: int) -> DataFrame:
        """rows (with digest) and what is verified of it, null where the digest is no hit."""
        if n_hits * 96 <= BROADCAST_BYTES:
            return rows.join(F.broadcast(verified), "digest", "left")
        numbered = rows.withColumn("_n", F.monotonically_increasing_id())
        return salted_join(numbered, verified, ["digest"], hot_keys(verified, ["digest"], n_rows, "n"), ["_n"], "left").drop("_n")

    def with_split(self, rows: DataFrame, split: DataFrame) -> DataFrame:
        """rows (with digest and text) of digests of several texts, and what holds for their text."""
        numbered = rows.withColumn("_n", F.monotonically_increasing_id())
        return salted_join(numbered, split, ["digest", "text"], hot_keys(split, ["digest", "text"], rows.count(), "n"), ["_n"]).drop("_n")

    def resolve(self) -> DataFrame:
        """One row per logged row: id, digest, min_id, max_id, n (of its group of equal texts)."""
        verified, n_hits, n_rows, split = self.verify()
        rows = self.joined(_union(self.logs).select("id", "digest"), verified, n_hits, n_rows)
        alone = lambda c: F.coalesce(F.col(c), F.col("id")).alias(c)
        out = rows.where(F.coalesce("same", F.lit(True))).select("id", "digest", alone("min_id"), alone("max_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))
        if split is None:
            return out
        texts = _union([b.withColumn("digest", self.digest(F.col("text"))) for b in self.batches])
        clash = self.joined(texts, verified, n_hits, n_rows).where("NOT same").select("id", "digest", "text")
        return out.unionByName(self.with_split(clash, split).select("id", "digest", "min_id", "max_id", "n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keeper(keep: str) -> str:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    return "min_id" if keep == "smallest" else "max_id"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtables: int = 4) -> DataFrame:
    """Per row of docs: id, digest (binary), keep_id, group_size and kept; keep is 'smallest' or 'largest' identifier."""
    keeper = F.col(_keeper(keep))
    groups = DigestIndex(memtables).add(docs, id_col, text_col).resolve()
    return groups.select(
        F.col("id").alias(id_col), "digest", keeper.alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(keeper)).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts, one of the smallest or largest identifier; all columns stay."""
    keeper = F.col(_keeper(keep))
    index = DigestIndex().add(docs, id_col, text_col)
    verified, n_hits, n_rows, split = index.verify()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the rows' own columns travel as one, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", index.digest(F.col("text")))
    rows = index.joined(rows, verified, n_hits, n_rows)
    equal = rows.where(F.coalesce("same", F.lit(False)) & F.col("id").eqNullSafe(keeper)).dropDuplicates(["digest"])
    out = rows.where("n IS NULL").select("row.*").unionByName(equal.select("row.*"))
    if split is not None:
        clash = index.with_split(rows.where("NOT same").select("row", "id", "digest", "text"), split)
        out = out.unionByName(clash.where(F.col("id").eqNullSafe(keeper)).dropDuplicates(["digest", "text"]).select("row.*"))
    return out
