"""Structured Streaming forms of the bounded buffers: reordering within a window of positions, deduplication, gap filters and
interval joins.

Place is event time: contig number and position as one time stamp, a millisecond a position, so the watermark moves with the
stream and a contig is complete when it has gone past it. A record's columns travel through state as JSON of their schema,
which gives every type back as it was."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from variform.functions import variant
from variform.operators.annotate import target_spans
from variform.operators.filtering import first_alt_count
from variform.sources.header import VariantHeader

CONTIG = 1 << 32


def _contig(df: DataFrame) -> Column:
    """The contig's number; of rows without one all positions count alike."""
    return F.coalesce("contig_idx", F.lit(0)) if "contig_idx" in df.columns else F.lit(0)


def with_position_time(df: DataFrame, window: int) -> DataFrame:
    """Places as event time: a record more than ``window`` positions behind the latest one is late."""
    place = _contig(df).cast("long") * CONTIG + F.col("pos")
    return df.withColumn("position_time", F.timestamp_millis(place)).withWatermark("position_time", f"{window} milliseconds")


def deduplicated(df: DataFrame, window: int) -> DataFrame:
    """The first record of each (chrom, pos, ref, alts) within the window; state older than the watermark is dropped."""
    timed = with_position_time(df, window).withColumn("_alts", F.array_join(F.array_sort(F.transform("alts", lambda a: F.upper(a))), ","))
    return timed.dropDuplicatesWithinWatermark(["chrom", "pos", "ref", "_alts"]).drop("_alts", "position_time")


def _packed(df: DataFrame, window: int, **more: Column) -> DataFrame:
    """chrom, contig, pos, row_id, the record as JSON, and more columns, with watermark."""
    timed = with_position_time(df, window)
    return timed.select("chrom", _contig(df).alias("contig"), "pos", "row_id", F.to_json(F.struct(*df.columns)).alias("record"), "position_time", *[c.alias(k) for k, c in more.items()])


def _unpacked(df: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    return df.select(F.from_json("record", like.schema).alias("r"), *more).select("r.*", *more)


def reordered(df: DataFrame, window: int) -> DataFrame:
    """Records of each contig in position order: held until the contig has moved on by ``window`` positions, or is complete
    (the watermark has gone past it, or a row of a null position says so). A record of a position that was already
    passed on, or of a complete contig, is an error."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, released, done = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, False)
        if state.hasTimedOut:
            out, held, done = sorted(held), [], True
        else:
            new, ended, contig = [], False, 0
            for b in batches:
                ended |= bool(b["pos"].isna().any())
                rows = b[b["pos"].notna()]
                new += [[int(p), int(i), r] for p, i, r in zip(rows["pos"], rows["row_id"], rows["record"], strict=True)]
                contig = int(b["contig"].max())
            if new and done:
                raise ValueError(f"{key[0]} was complete before its record at {min(new)[0]}")
            if new and min(new)[0] < released:
                raise ValueError(f"record at {key[0]}:{min(new)[0]} is later than the reorder window")
            held = sorted(held + new)
            limit = float("inf") if ended else held[-1][0] - window if held else 0
            out, held, done = [h for h in held if h[0] <= limit], [h for h in held if h[0] > limit], done or ended
            if held:
                state.setTimeoutTimestamp(contig * CONTIG + held[-1][0] + window + 1)
        if out:
            released = out[-1][0]
        state.update((json.dumps(held), released, done))
        if out:
            yield pd.DataFrame({"record": [h[2] for h in out]})

    packed = _packed(df, window)
    out = packed.groupBy("chrom").applyInPandasWithState(run, "record string", "held string, released long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return _unpacked(out, df)


# ---------------------------------------------------------------- gaps

@dataclass
class _Held:
    """A record that waits for what its neighbours say of it."""

    record: str
    reach: int
    snp: bool
    marks: list[str]
    chain: int | None = None


class GapBuffer:
    """Gap marks of the records of one contig, fed in position order: a record is passed on when none that may still come can
    mark it, so the buffer holds no more than the gaps reach."""

    def __init__(self, snp: int | None, indel: int | None, state: dict | None = None):
        self.snp, self.indel = snp, indel
        s = state or {"held": [], "listed": -1, "plain": -1, "last": 0, "chains": 0, "chain": []}
        self.held = [_Held(**h) for h in s["held"]]
        #: The furthest reach of earlier listed records, of all and of those that are no SNP; the last position; the open chain.
        self.listed, self.plain, self.last, self.chains, self.chain = s["listed"], s["plain"], s["last"], s["chains"], s["chain"]

    def state(self) -> dict:
        return {"held": [asdict(h) for h in self.held], "listed": self.listed, "plain": self.plain, "last": self.last, "chains": self.chains, "chain": self.chain}

    def feed(self, pos: int, end: int, record: str, snp: bool, listed: bool, indel: bool, qual: float | None, count: int | None) -> Iterator[tuple[str, list[str]]]:
        if pos < self.last:
            raise ValueError(f"position {pos} follows {self.last}: gap filters need sorted records")
        self.last = pos
        if self.chain and pos > self.chain[-1]["until"]:
            self._close()
        new = _Held(record, end + (self.snp or 0), snp and self.snp is not None, [])
        if self.snp is not None:
            for h in self.held:
                if listed and h.snp and h.reach >= pos and "SnpGap" not in h.marks:
                    h.marks.append("SnpGap")
            if snp and (self.plain if listed else self.listed) >= pos:
                new.marks.append("SnpGap")
            if listed:
                self.listed = max(self.listed, new.reach)
                self.plain = self.plain if snp else max(self.plain, new.reach)
        if indel and self.indel is not None:
            new.chain = self.chains
            self.chain.append({"until": end + self.indel, "qual": qual, "count": count})
        self.held.append(new)
        yield from self._passed(pos)

    def finish(self) -> Iterator[tuple[str, list[str]]]:
        self._close()
        yield from self._passed(None)

    def _close(self) -> None:
        """The best of the chain stays: the highest QUAL above 0, or where the first has none the most copies of the ALT."""
        if self.chain:
            top = max((c["qual"] for c in self.chain if c["qual"] is not None), default=None)
            if self.chain[0]["qual"] is not None and top is not None and top > 0:
                worth = [c["qual"] if c["qual"] is not None else float("-inf") for c in self.chain]
            else:
                worth = [c["count"] if c["count"] is not None else (0 if i == 0 else -1) for i, c in enumerate(self.chain)]
            best = worth.index(max(worth))
            for i, h in enumerate(h for h in self.held if h.chain == self.chains):
                if i != best:
                    h.marks.append("IndelGap")
        self.chains, self.chain = self.chains + 1, []

    def _passed(self, pos: int | None) -> Iterator[tuple[str, list[str]]]:
        n = 0
        for h in self.held:
            waits = pos is not None and ((h.snp and "SnpGap" not in h.marks and h.reach >= pos) or (h.chain is not None and h.chain == self.chains))
            if waits:
                break
            n += 1
            yield h.record, h.marks
        del self.held[:n]


def gap_marked(df: DataFrame, header: VariantHeader, *, snp: tuple[int, str] | int | None = None, indel: int | None = None) -> DataFrame:
    """Streamed records with marks, array<string> of SnpGap and IndelGap, each passed on when its neighbourhood is complete.

    Records come in position order; one that does not, or that follows its contig's end, is an error. A contig ends when
    the watermark has gone past it, or with a row of a null position."""
    distance, types = snp if isinstance(snp, tuple) else (snp, "indel")
    bits, mask = variant.class_bits(types), variant.record_class()
    window = max(distance or 0, indel or 0) + 1
    flag = lambda b: F.coalesce(mask.bitwiseAND(b) != 0, F.lit(False))
    end = (F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1).cast("int")
    packed = _packed(df, window, end=end, snp=flag(variant.SNP), listed=flag(bits), indel=flag(variant.INDEL), qual=F.col("qual").cast("double"), n_first=first_alt_count(header).cast("double"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, done = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, False)
        buffer, out = GapBuffer(distance, indel, kept), []
        if state.hasTimedOut:
            out, done = list(buffer.finish()), True
        else:
            contig, ended = 0, False
            parts = list(batches)
            rows = pd.concat(parts)
            ended = bool(rows["pos"].isna().any())
            contig = int(rows["contig"].max())
            rows = rows[rows["pos"].notna()].sort_values("row_id", kind="stable")
            if len(rows) and done:
                raise ValueError(f"{key[0]} is not one block: a record follows its end")
            value = lambda x: None if pd.isna(x) else float(x)
            for r in rows.itertuples(index=False):
                out += buffer.feed(int(r.pos), int(r.end), r.record, bool(r.snp), bool(r.listed), bool(r.indel), value(r.qual), value(r.n_first))
            if ended:
                out, done = out + list(buffer.finish()), True
            elif buffer.held:
                state.setTimeoutTimestamp(contig * CONTIG + buffer.last + window + 1)
        state.update((json.dumps(buffer.state()), done))
        if out:
            yield pd.DataFrame({"record": [r for r, _ in out], "marks": [m for _, m in out]})

    out = packed.groupBy("chrom").applyInPandasWithState(run, "record string, marks array<string>", "kept string, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return _unpacked(out, df, "marks")


def annotated(stream: DataFrame, header: VariantHeader, intervals: DataFrame, width: int = 1 << 12) -> DataFrame:
    """Every streamed record with every interval of a static table that it overlaps (row_id and the interval's columns)."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    t = target_spans(stream, header).withColumn("_bin", bins("start", "end"))
    s = intervals.withColumnRenamed("chrom", "_chrom").withColumn("_sbin", bins("from", "to"))
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("from") / width))
    held = (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_sbin")) & (F.col("from") <= F.col("end")) & (F.col("to") >= F.col("start")) & (F.col("_bin") == first)
    return t.join(s, held).drop("_bin", "_sbin", "_chrom")
