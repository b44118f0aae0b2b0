"""Regions: the grammar, merging, and overlap as a predicate or a join."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.functions import variant

LAST = 2147483647
#: Up to so many merged intervals become comparisons, which reach the scan; up to INLINE one literal array; more are joined.
COMPARED, INLINE = 16, 256


def parse_region(text: str, contigs: Iterable[str] = ()) -> tuple[str, int, int]:
    """chr, chr:pos (that base), chr:a-b, chr:a- (open); commas in numbers are ignored."""
    known = set(contigs)
    if text in known or ":" not in text:
        return text, 1, LAST
    name, _, span = text.rpartition(":")
    m = re.fullmatch(r"([\d,]+)(-([\d,]*))?", span)
    if not m:
        raise ValueError(f"bad region {text}")
    start = int(m[1].replace(",", ""))
    end = start if m[2] is None else int(m[3].replace(",", "")) if m[3] else LAST
    if start < 1 or end < start:
        raise ValueError(f"bad region {text}")
    return name, start, end


def read_regions(lines: Iterable[str], bed: bool = False) -> list[tuple[str, int, int]]:
    """chrom, start, end rows of a list file; BED starts count from zero."""
    out = []
    for line in lines:
        if not line.strip() or line.startswith("#"):
            continue
        cols = line.rstrip("\r\n").split("\t")
        if len(cols) == 1:
            out.append(parse_region(cols[0].strip()))
            continue
        start = int(cols[1]) + (1 if bed else 0)
        end = int(cols[2]) if len(cols) > 2 else start
        if end < start:
            raise ValueError(f"empty interval: {line!r}")
        out.append((cols[0], start, end))
    return out


def merged(regions: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Sorted, with overlapping and adjacent intervals joined."""
    out: list[list] = []
    for chrom, start, end in sorted(regions):
        if out and out[-1][0] == chrom and start <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([chrom, start, end])
    return [tuple(r) for r in out]


def span(mode: str, info_end: Column | None = None) -> tuple[Column, Column]:
    """First and last position that a record occupies in a mode: pos, record or variant (null start: none)."""
    pos = F.col("pos")
    own = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    end = own if info_end is None else F.when(info_end >= pos, info_end).otherwise(own)
    if mode == "pos":
        return pos, pos
    if mode == "record":
        return pos, end
    if mode != "variant":
        raise ValueError(f"unknown overlap mode {mode}")
    shared = F.array_min(F.transform("alts", lambda a: variant.common_prefix(F.col("ref"), a)))
    start = pos + F.least(shared, end - pos + 1)
    return F.when((F.size("alts") > 0) & (start <= end), start), end


def overlap(regions: Iterable[tuple[str, int, int]], mode: str, info_end: Column | None = None) -> Column:
    """Two-valued predicate: does the record overlap any region?"""
    start, end = span(mode, info_end)
    regions = merged(regions)
    if len(regions) > COMPARED:
        listed = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for c, lo, hi in regions])
        place = F.struct(F.col("chrom").alias("c"), start.alias("s"), end.alias("e"))
        hit = variant.let(place, lambda p: F.exists(listed, lambda r: (r["c"] == p["c"]) & (p["s"] <= r["hi"]) & (p["e"] >= r["lo"])))
        return F.coalesce(hit, F.lit(False))
    out = F.lit(False)
    for chrom, lo, hi in regions:
        out = out | ((F.col("chrom") == chrom) & (start <= hi) & (end >= lo))
    return F.coalesce(out, F.lit(False))


def select_regions(df: DataFrame, regions: Iterable[tuple[str, int, int]], mode: str = "record", negate: bool = False, info_end: Column | None = None) -> DataFrame:
    """Rows that overlap the regions (or that do not)."""
    regions = merged(regions)
    if len(regions) <= INLINE:
        held = overlap(regions, mode, info_end)
        return df.where(~held if negate else held)
    start, end = span(mode, info_end)
    held = _looked_up(df.withColumns({"_start": start, "_end": end}), regions)
    return held.where(~F.col("_held") if negate else F.col("_held")).select(*df.columns)


def _looked_up(df: DataFrame, regions: list[tuple[str, int, int]], width: int = 1 << 14) -> DataFrame:
    """df with _held: whether [_start, _end] overlaps one of many merged regions.

    The regions become one row for every bin of positions up to the last start, with those that reach into the bin and the
    number of earlier starts. A record asks the bins of its first and last position (two equi-joins, one row each): it
    overlaps if a region covers the first, or if more regions start up to the last than up to the first."""
    rows, last = [], {}
    by_chrom: dict[str, list[tuple[int, int]]] = {}
    for chrom, lo, hi in regions:
        by_chrom.setdefault(chrom, []).append((lo, hi))
    for chrom, own in by_chrom.items():
        last[chrom] = own[-1][0] // width
        bins: list[list[tuple[int, int]]] = [[] for _ in range(last[chrom] + 1)]
        for lo, hi in own:
            for b in range(lo // width, min(hi // width, last[chrom]) + 1):
                bins[b].append((lo, hi))
        started = 0
        for b, reached in enumerate(bins):
            rows.append((chrom, b, started, reached))
            started += sum(lo // width == b for lo, _ in reached)
    table = df.sparkSession.createDataFrame(rows, "_c string, _b int, _n int, _r array<struct<lo:int,hi:int>>")
    ends = F.create_map(*[F.lit(x) for kv in last.items() for x in kv])

    def asked(out: DataFrame, at: str, name: str) -> DataFrame:
        found = table.select(F.col("_c").alias("_c" + name), F.col("_b").alias("_b" + name), F.struct("_b", "_n", "_r").alias(name))
        place = F.least(F.floor(F.col(at) / width), F.try_element_at(ends, F.col("chrom")))
        return out.join(found, (F.col("chrom") == F.col("_c" + name)) & (place == F.col("_b" + name)), "left").drop("_c" + name, "_b" + name)

    out = asked(asked(df, "_start", "_first"), "_end", "_last")
    covers = F.exists("_first._r", lambda r: (r["lo"] <= F.col("_start")) & (r["hi"] >= F.col("_start")))

    def starts_to(row: str, at: str) -> Column:
        return F.col(f"{row}._n") + F.size(F.filter(f"{row}._r", lambda r: (r["lo"] <= F.col(at)) & (F.floor(r["lo"] / width) == F.col(f"{row}._b"))))

    held = covers | (starts_to("_last", "_end") > starts_to("_first", "_start"))
    return out.withColumn("_held", F.coalesce(held & (F.col("_end") >= F.col("_start")), F.lit(False)))
