"""Normalisation: splitting, joining, deduplication, sorting, reference alignment and atoms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from variform.functions import variant
from variform.operators.annotate import overlap_join
from variform.operators.ordered import last_before
from variform.sources.header import Field, VariantHeader

MAX_PLOIDY = 8


def genotypes(alleles: int, ploidy: int) -> int:
    """Number of genotypes: multisets of ``ploidy`` out of ``alleles``."""
    out = 1
    for i in range(ploidy):
        out = out * (alleles + i) // (i + 1)
    return out


def _choose(n: Column, k: int) -> Column:
    """n over k for a column n and a small k."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.floor(out * (n - i) / (i + 1)).cast("long")
    return out


def genotype_subset(values: Column, n_alleles: Column, allele: Column) -> Column:
    """Of a Number=G array, the genotypes of REF and one ALT: j copies of it in a call of p, j = 0..p.

    The ploidy is the one whose number of genotypes is the array's length."""
    out = F.raise_error(F.lit("Number=G array fits no ploidy")).cast("array<int>")
    for p in range(MAX_PLOIDY, 0, -1):
        # sorted alleles a1 <= ... <= ap stand at sum of C(ai + i - 1, i): zeros add nothing, the last j are the ALT
        places = [F.lit(0).cast("long")]
        for j in range(1, p + 1):
            at = F.lit(0).cast("long")
            for i in range(p - j + 1, p + 1):
                at = at + _choose(allele + i - 1, i)
            places.append(at)
        out = F.when(F.size(values) == _choose(n_alleles + p - 1, p), F.array(*places).cast("array<int>")).otherwise(out)
    return F.transform(out, lambda i: F.get(values, i))


def _subset(value: Column, f: Field, n_alleles: Column, allele: Column) -> Column:
    if f.scalar or f.number not in ("A", "R", "G"):
        return value
    if f.number == "A":
        picked = F.array(F.get(value, allele - 1))
    elif f.number == "R":
        picked = F.array(F.get(value, F.lit(0)), F.get(value, allele))
    else:
        picked = genotype_subset(value, n_alleles, allele)
    return F.when(value.isNotNull() & (F.size(value) > 0), picked)


def split_multiallelic(df: DataFrame, header: VariantHeader, *, overlaps_missing: bool = False, keep_sum: bool = False) -> DataFrame:
    """One row per ALT, with part (its number from 0). Records with fewer than two ALTs stay as they are.

    A call's own allele becomes 1, REF stays 0, others become 0 (missing with overlaps_missing). keep_sum: the REF depth
    of FORMAT/AD takes the other ALTs' depths."""
    many = F.size("alts") > 1
    out = df.withColumn("part", F.explode(F.when(many, F.sequence(F.lit(0), F.size("alts") - 1)).otherwise(F.array(F.lit(0)))))
    allele, n = F.col("part") + 1, F.size("alts") + 1
    if "info" in df.columns:
        fields = [F.when(many, _subset(F.col("info")[k], f, n, allele)).otherwise(F.col("info")[k]).alias(k) for k, f in header.infos.items()]
        out = out.withColumn("info", F.struct(*fields))
    if "samples" in df.columns:
        other = F.lit(None).cast("int") if overlaps_missing else F.lit(0)

        def sample(s: Column) -> Column:
            fields = []
            for k, f in header.formats.items():
                v = s[k]
                if k == "GT":
                    alleles = F.transform(v["alleles"], lambda a: F.when(a.isNull(), a).when(a == allele, 1).when(a == 0, 0).otherwise(other))
                    new = F.when(v.isNotNull(), F.struct(alleles.alias("alleles"), v["phased"].alias("phased")))
                elif keep_sum and k == "AD" and f.number == "R":
                    total = F.aggregate(v, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
                    own = F.get(v, allele)
                    new = F.when(v.isNotNull() & (F.size(v) > 0), F.array((total - F.coalesce(own, F.lit(0))).cast("int"), own))
                else:
                    new = _subset(v, f, n, allele)
                fields.append(F.when(many, new).otherwise(v).alias(k))
            return F.struct(*fields)

        out = out.withColumn("samples", F.transform("samples", sample))
    alts = F.when(many, F.array(F.get("alts", F.col("part")))).otherwise(F.col("alts"))
    return out.withColumn("alts", alts).select(*df.columns, "part")


def remove_duplicates(df: DataFrame, header: VariantHeader, policy: str = "exact") -> DataFrame:
    """Drop later records of a coordinate: exact (REF and the set of ALTs), all, snps, indels or both.

    The class policies keep a record unless an earlier kept one shares its class: the first of each class is kept, and
    which records those are depends only on the records of one coordinate."""
    order = ["row_id", *(["part"] if "part" in df.columns else [])]
    at = Window.partitionBy("chrom", "pos")
    if policy == "all":
        # kept as long as nothing of any class was kept before
        return df.withColumn("_n", F.row_number().over(at.orderBy(*order))).where("_n = 1").drop("_n")
    if policy == "exact":
        named = F.transform("alts", lambda a: F.upper(a))
        if "SVLEN" in header.infos:
            svlen = F.col("info.SVLEN") if header.infos["SVLEN"].scalar else F.get("info.SVLEN", F.lit(0))
            first = F.get(named, F.lit(0))
            named = F.when((F.size("alts") == 1) & first.startswith("<") & svlen.isNotNull(), F.array(F.concat(first, F.lit("."), svlen.cast("string")))).otherwise(named)
        key = Window.partitionBy("chrom", "pos", "_ref", "_alts", "_n")
        keyed = df.withColumns({"_ref": F.upper("ref"), "_alts": F.array_sort(named), "_n": F.size("alts")})
        return keyed.withColumn("_k", F.row_number().over(key.orderBy(*order))).where("_k = 1").select(*df.columns)
    snp, indel = variant.SNP | variant.MNP, variant.INDEL
    wanted = {"snps": [snp], "indels": [indel], "both": [snp, indel]}[policy]
    # A fold over the (few) records of each coordinate: the classes kept so far decide on the next one.
    keyed = df.withColumn("_mask", variant.record_class())
    history = F.collect_list("_mask").over(at.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))

    def clashes(mask: Column, seen: Column) -> Column:
        out = F.lit(False)
        for bits in wanted:
            out = out | ((mask.bitwiseAND(bits) != 0) & (seen.bitwiseAND(bits) != 0))
        return out

    seen = F.aggregate(history, F.lit(0), lambda acc, m: F.when(clashes(m, acc), acc).otherwise(acc.bitwiseOR(m)))
    return keyed.withColumn("_seen", seen).where(~clashes(F.col("_mask"), F.col("_seen"))).select(*df.columns)


def sort_local(df: DataFrame, how: str = "pos") -> DataFrame:
    """Global order by contig and position: stable (pos), or by REF and ALTs ignoring case, then fewer ALTs (lex)."""
    order = ["row_id", *(["part"] if "part" in df.columns else [])]
    if how == "lex":
        return df.orderBy("contig_idx", "pos", F.lower("ref"), F.transform("alts", lambda a: F.lower(a)), F.size("alts"), *order)
    return df.orderBy("contig_idx", "pos", *order)


def with_previous(df: DataFrame) -> DataFrame:
    """(row_id, contig_idx, pos, before) with before the struct of the three of the row before it.

    Chunks of row_id are windows, their first rows meet the last rows of the chunks before."""
    place = F.struct("row_id", "contig_idx", "pos")
    chunked = df.select("row_id", "contig_idx", "pos", F.floor(F.col("row_id") / (1 << 18)).alias("chunk"))
    ends = chunked.groupBy("chunk").agg(F.max(place).alias("l"))
    w = Window.partitionBy("chunk").orderBy("row_id")
    rows = chunked.join(last_before(ends, "chunk", "l", "p"), "chunk")
    return rows.select("row_id", "contig_idx", "pos", F.coalesce(F.lag(place).over(w), F.col("p")).alias("before"))


def check_order(df: DataFrame) -> DataFrame:
    """(row_id, problem) of records that break the input order: contig order, contiguous contigs, positions."""
    problem = F.when(F.col("before.contig_idx") > F.col("contig_idx"), "contig-order").when(
        (F.col("before.contig_idx") == F.col("contig_idx")) & (F.col("before.pos") > F.col("pos")), "position-order"
    )
    return with_previous(df).withColumn("problem", problem).where("problem IS NOT NULL").select("row_id", "problem")


# ---------------------------------------------------------------- joining

JOIN_TARGETS = {"snps": [variant.SNP], "indels": [variant.INDEL], "both": [variant.SNP, variant.MNP, variant.INDEL, variant.OTHER]}


def _merge_group(rows: list[dict], header: VariantHeader, strict_filter: bool, strict_ref: bool = True) -> dict:
    """One record of several at a coordinate; the first gives whatever has no rule of its own."""
    ref = max((r["ref"] for r in rows), key=len)
    if strict_ref and any(not ref.upper().startswith(r["ref"].upper()) for r in rows):
        raise ValueError(f"cannot join incompatible REF alleles at {rows[0]['chrom']}:{rows[0]['pos']}")
    if len({r["ref"][: len(rows[0]["ref"])] for r in rows}) > 1:
        ref = ref.upper()
    alts: list[str] = []
    maps = []
    for r in rows:
        extra, mapping = ref[len(r["ref"]) :], [0]
        for a in r["alts"]:
            wide = a if a[:1] in "<*" else a + extra
            place = next((i for i, b in enumerate(alts) if b.upper() == wide.upper()), None)
            if place is None:
                alts.append(wide)
                place = len(alts) - 1
            mapping.append(place + 1)
        maps.append(mapping)
    out = dict(rows[0], ref=ref, alts=alts)
    out["ids"] = list(dict.fromkeys(i for r in rows for i in r["ids"]))
    quals = [r["qual"] for r in rows if r["qual"] is not None]
    out["qual"] = max(quals) if quals else None
    filters: list[str] = []
    for r in rows:
        fs = list(r["filters"])
        if strict_filter and fs == ["PASS"]:
            filters = ["PASS"]
        elif fs != ["PASS"] or not filters:
            filters = list(dict.fromkeys([f for f in filters if f != "PASS" or fs == ["PASS"]] + fs))
    out["filters"] = filters
    n = len(alts) + 1

    def lay(values: list, f: Field, ploidy: int = 2):
        """Values of a Number=A, R or G field in the merged order; the first record decides whether there is any."""
        if values[0] is None:
            return None
        size = {"A": n - 1, "R": n, "G": genotypes(n, ploidy)}[f.number]
        new: list = [None] * size
        for v, m in zip(values, maps, strict=True):
            if v is None:
                continue
            for i, x in enumerate(v):
                if f.number == "G":
                    place = _genotype_place(i, len(v), m, ploidy)
                else:
                    own = i + 1 if f.number == "A" else i
                    place = m[own] - (f.number == "A") if own < len(m) else None
                if place is None or place >= size:
                    continue
                if f.type in ("Integer", "Float") or new[place] is None:
                    new[place] = x
        return new

    for k, f in header.infos.items():
        if not f.scalar and f.number in ("A", "R", "G"):
            out["info"] = dict(out["info"], **{k: lay([r["info"][k] for r in rows], f)})
    samples = []
    for i in range(len(rows[0]["samples"] if rows[0].get("samples") is not None else [])):
        s = dict(rows[0]["samples"][i])
        for k, f in header.formats.items():
            values = [r["samples"][i][k] for r in rows]
            if k == "GT":
                s[k] = _merge_gt(values, maps)
            elif not f.scalar and f.number in ("A", "R", "G"):
                haploid = f.number == "G" and all(v is None or len(v) == len(m) for v, m in zip(values, maps, strict=True))
                s[k] = lay(values, f, 1 if haploid else 2)
        samples.append(s)
    if samples:
        out["samples"] = samples
    return out


def _genotype_place(i: int, size: int, mapping: list[int], ploidy: int) -> int | None:
    """Place of a record's i-th genotype among the merged ones (ploidy 1 or 2)."""
    if ploidy == 1 or size == len(mapping):
        a = mapping[i] if i < len(mapping) else None
        return a if ploidy == 1 else None if a is None else a * (a + 1) // 2 + a
    high = 0
    while (high + 1) * (high + 2) // 2 <= i:
        high += 1
    low = i - high * (high + 1) // 2
    if high >= len(mapping):
        return None
    a, b = sorted((mapping[low], mapping[high]))
    return b * (b + 1) // 2 + a


def _merge_gt(calls: list, maps: list[list[int]]):
    """The first call, its REF and missing alleles filled by the first later call that has an ALT there."""
    merged = None
    for call, m in zip(calls, maps, strict=True):
        if call is None or call["alleles"] is None:
            continue
        alleles = [None if a is None else m[a] for a in call["alleles"]]
        if merged is None:
            merged = {"alleles": alleles, "phased": list(call["phased"])}
            continue
        for i, a in enumerate(alleles[: len(merged["alleles"])]):
            if a and not merged["alleles"][i]:
                merged["alleles"][i] = a
    return merged


def join_multiallelic(df: DataFrame, header: VariantHeader, policy: str = "any", strict_filter: bool = False, strict_ref: bool = True) -> DataFrame:
    """One record of those at a coordinate whose classes the policy joins (snps, indels, both or any), in input order.

    REF alleles that no longer one begins with are an error; without strict_ref the first of the longest stands for all.
    Coordinates with one record never reach Python."""
    schema = df.schema
    crowded = df.groupBy("chrom", "pos").agg(F.count("*").alias("c")).where("c > 1").select("chrom", "pos")
    alone = df.join(crowded, ["chrom", "pos"], "left_anti").select(*df.columns)
    several = df.join(crowded, ["chrom", "pos"], "left_semi").withColumn("_mask", variant.record_class().bitwiseAND(~variant.REF & 0xFF)).select(*df.columns, "_mask")

    kind = to_arrow_schema(schema)

    def groups_of(rows: list[dict]) -> list[list[dict]]:
        if policy == "any":
            return [rows]
        rows = sorted(rows, key=lambda r: r["_mask"])
        groups = []
        while rows:
            size = 0
            for target in JOIN_TARGETS[policy]:
                size = 0
                while size < len(rows) and rows[size]["_mask"] in (0, target):
                    size += 1
                if size:
                    break
            size = max(size, 1)
            groups.append(rows[:size])
            rows = rows[size:]
        return groups

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted, so a coordinate's stand together; only one coordinate's are held
        held: list[dict] = []

        def merged() -> list[dict]:
            return [g[0] if len(g) == 1 else _merge_group(g, header, strict_filter, strict_ref) for g in groups_of(held)] if held else []

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if held and (held[0]["chrom"], held[0]["pos"]) != (row["chrom"], row["pos"]):
                    made += merged()
                    held = []
                held.append(row)
            if made:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in kind.names} for r in made], schema=kind)
        if held:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in kind.names} for r in merged()], schema=kind)

    ordered = several.repartition("chrom", "pos").sortWithinPartitions("chrom", "pos", "row_id")
    return alone.unionByName(ordered.mapInArrow(fold, schema))


# ---------------------------------------------------------------- reference

def align(pos: int, ref: str, alts: list[str], context: str, context_start: int, right: bool = False) -> tuple[int, str, list[str], bool]:
    """Left- (or right-) aligned, trimmed alleles; context is the reference from context_start. The flag tells that the
    context was too short to decide."""
    alleles = [ref.upper(), *(a.upper() for a in alts)]
    base = lambda p: context[p - context_start] if 0 <= p - context_start < len(context) else None
    if right:
        end = pos + len(ref) - 1
        # drop the shared first base, then extend at the end while an allele would be empty and the bases agree
        while True:
            if all(len(a) > 1 for a in alleles) and len({a[0] for a in alleles}) == 1:
                alleles, pos = [a[1:] for a in alleles], pos + 1
                continue
            nxt = base(end + 1)
            if len({len(a) for a in alleles}) == 1 or min(map(len, alleles)) > 1 or len({a[0] for a in alleles}) > 1:
                return (*_anchored(pos, alleles, base), False)
            if nxt is None:
                return (*_anchored(pos, alleles, base), True)
            alleles, pos, end = [a[1:] + nxt for a in alleles], pos + 1, end + 1
    while True:
        if len({a[-1] for a in alleles}) > 1:
            break
        if all(len(a) > 1 for a in alleles):
            alleles = [a[:-1] for a in alleles]
            continue
        before = base(pos - 1)
        if before is None:
            if pos > 1:
                return pos, alleles[0], alleles[1:], True
            break
        alleles, pos = [before + a[:-1] for a in alleles], pos - 1
    while all(len(a) > 1 for a in alleles) and len({a[0] for a in alleles}) == 1:
        alleles, pos = [a[1:] for a in alleles], pos + 1
    return pos, alleles[0], alleles[1:], False


def _anchored(pos: int, alleles: list[str], base) -> tuple[int, str, list[str]]:
    return pos, alleles[0], alleles[1:]


def with_reference(df: DataFrame, fasta: DataFrame, chunk: int, margin: int | None = None, only: Column | None = None) -> DataFrame:
    """df with context (reference bases) and context_start, by an equi-join on chunks: the bases from ``margin`` before to
    margin behind REF, cut out where the join meets, or without margin the record's chunk and its neighbours. only: the
    records that are looked up (the others meet nothing)."""
    beside = chunk if margin is None else margin
    around = [
        fasta.select(F.col("chrom").alias("_c"), (F.col("chunk") - d).alias("_k"), F.struct(F.lit(d).alias("d"), part.alias("seq")).alias("p"))
        for d, part in ((-1, F.substring("seq", -beside, beside)), (0, F.col("seq")), (1, F.substring("seq", 1, beside)))
    ]
    pieces = around[0].unionByName(around[1]).unionByName(around[2]).groupBy("_c", "_k").agg(F.array_sort(F.collect_list("p")).alias("p"))
    ahead = F.when(F.get("p", F.lit(0))["d"] == -1, F.length(F.get("p", F.lit(0))["seq"])).otherwise(0)
    pieces = pieces.select("_c", "_k", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("_seq"), (F.greatest("_k", F.lit(0)) * chunk + 1 - ahead).cast("int").alias("_from"))
    at = F.floor((F.col("pos") - 1) / chunk)
    if only is not None:
        at = F.when(only, at).otherwise(-2 - F.pmod("row_id", F.lit(1 << 20)))  # no chunk, and no one task
    out = df.withColumn("_at", at).join(pieces, (F.col("chrom") == F.col("_c")) & (F.col("_at") == F.col("_k")), "left")
    if margin is None:
        return out.select(*df.columns, F.col("_seq").alias("context"), F.col("_from").alias("context_start"))
    start = F.greatest(F.col("pos") - margin, F.col("_from"))
    bases = F.substring("_seq", start - F.col("_from") + 1, F.col("pos") - start + F.length("ref") + margin)
    return out.select(*df.columns, bases.alias("context"), start.alias("context_start"))


def normalize(df: DataFrame, fasta: DataFrame, chunk: int = 1 << 16, transcripts: DataFrame | None = None, window: int = 256) -> DataFrame:
    """Left-align and trim against the reference (right-align on forward-only transcripts). Symbolic alleles, '*',
    breakends and records without an ALT stay as they are; IUPAC codes in REF count as their first base.

    Raises if a repeat is longer than the chunk before (or after) the record's own."""
    plain = (F.size("alts") > 0) & F.col("ref").rlike("(?i)^[ACGTNRYSWKMBDHV]+$") & F.forall("alts", lambda a: a.rlike("(?i)^[ACGTN]+$"))
    rows = df.withColumn("_ok", plain)
    if transcripts is not None:
        found = transcript_direction(df, transcripts).withColumnsRenamed({c: f"_{c}" for c in ("chrom", "start", "end", "right")})
        at = (F.col("chrom") == F.col("_chrom")) & (F.col("pos") == F.col("_start")) & (F.col("pos") + F.length("ref") == F.col("_end"))
        rows = rows.join(found, at, "left").withColumn("_right", F.coalesce("_right", F.lit(False))).drop("_chrom", "_start", "_end")
    else:
        rows = rows.withColumn("_right", F.lit(False))
    result = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("ref", T.StringType()), T.StructField("alts", T.ArrayType(T.StringType())), T.StructField("short", T.BooleanType())])

    @F.pandas_udf(result)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for pos, ref, alts, context, start, ok, right in batches:
            out = []
            for p, r, a, c, s, k, d in zip(pos, ref, alts, context, start, ok, right, strict=True):
                out.append(align(int(p), r, list(a), c.upper(), int(s), bool(d)) if k else (p, r, list(a), False))
            yield pd.DataFrame(out, columns=["pos", "ref", "alts", "short"])

    def aligned(found: DataFrame, ok: Column) -> DataFrame:
        column = run("pos", "ref", "alts", F.when(ok, F.col("context")).otherwise(""), F.coalesce("context_start", F.lit(0)), ok & F.col("context").isNotNull(), "_right")
        return found.withColumn("_a", column).drop("context", "context_start")

    # nearly all records are settled by a short window; only the others meet the chunks around them
    near = aligned(with_reference(rows, fasta, chunk, window), F.col("_ok"))
    near = near.withColumn("_n", F.when(~F.col("_a.short"), F.col("_a"))).drop("_a")
    far = aligned(with_reference(near, fasta, chunk, only=F.col("_n").isNull()), F.col("_n").isNull())
    failed = F.raise_error(F.concat(F.lit("reference context too short at "), F.col("pos").cast("string"))).cast(result)
    done = far.withColumn("_n", F.coalesce("_n", F.when(F.col("_a.short"), failed).otherwise(F.col("_a"))))
    return done.select(*[F.col(f"_n.{c}").alias(c) if c in ("pos", "ref", "alts") else F.col(c) for c in df.columns])


def covered(intervals: DataFrame, bin_width: int = 1 << 13) -> DataFrame:
    """(chrom, from, to): disjoint intervals that cover the places of the given ones.

    Intervals that start in one bin are merged there, one a start; of a bin's runs only what no earlier bin reaches stays."""
    longest = intervals.groupBy("chrom", "from").agg(F.max("to").alias("to")).withColumn("_bin", F.floor(F.col("from") / bin_width))
    inside = Window.partitionBy("chrom", "_bin").orderBy("from")
    reach = F.max("to").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    begins = longest.withColumn("_begins", (reach.isNull() | (F.col("from") > reach + 1)).cast("int"))
    runs = begins.withColumn("_run", F.sum("_begins").over(inside)).groupBy("chrom", "_bin", "_run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    # a row a bin
    ends = runs.groupBy("chrom", "_bin").agg(F.max("to").alias("_to"))
    before = F.max("_to").over(Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    rest = runs.join(ends.select("chrom", "_bin", before.alias("_before")), ["chrom", "_bin"])
    start = F.greatest("from", F.coalesce(F.col("_before") + 1, F.col("from")))
    return rest.select("chrom", start.cast("int").alias("from"), F.col("to").cast("int").alias("to")).where("`to` >= `from`")


def transcript_direction(df: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(chrom, start, end, right) of every span of the records that meets a transcript, up to the base behind REF: only forward
    ones overlap it; those of unknown strand do not count.

    What matters is which places the transcripts of a strand cover, so pairs grow with neither records nor transcripts."""
    spans = df.select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.length("ref")).alias("end")).distinct()
    known = transcripts.select("chrom", F.col("start").alias("from"), F.col("end").alias("to"), "reverse")
    strands = [covered(known.where(F.col("reverse") == reverse)).withColumn("reverse", F.lit(reverse)) for reverse in (False, True)]
    return overlap_join(spans, strands[0].unionByName(strands[1])).groupBy("chrom", "start", "end").agg((~F.bool_or("reverse")).alias("right"))


# Ambiguity codes and the first base that each stands for.
AMBIGUOUS, FIRST_BASE = "RWMDHVYSBKrwmdhvysbk", "AAAAAACCCGaaaaaacccg"


def _ordinary(a: Column) -> Column:
    """A sequence, not a symbolic allele, '*', '.' or breakend."""
    return ~a.rlike(r"^$|^<|^\.$|^\*$|[\[\]]")


def _by_base(a: Column, f) -> Column:
    """a with every base c at place i (from 0) replaced by f(c, i)."""
    return F.array_join(F.transform(F.split(a, ""), f), "")


def check_reference(df: DataFrame, fasta: DataFrame, mode: str = "e", chunk: int = 1 << 16) -> DataFrame:
    """REF against the reference: 'e' fails on a mismatch, 'w' adds mismatch (boolean), 'x' drops, 's' repairs.

    To repair, ambiguity codes become their first base and N in REF (and in ALTs at its place) the reference's base. Then REF
    and an ALT equal to the reference change places, with GT, and INFO/AC of that ALT counts the old REF; without such
    an ALT, REF becomes the reference's bases, and ALTs follow where they had REF's base. ALTs equal to REF are dropped,
    their calls become REF. Records of unknown contigs stay."""
    rows = with_reference(df, fasta, chunk)
    real = F.translate(F.upper(F.substring("context", F.col("pos") - F.col("context_start") + 1, F.length("ref"))), AMBIGUOUS, FIRST_BASE)
    bad = F.coalesce((F.upper("ref") != real) | ~F.col("ref").rlike("(?i)^[ACGTN]+$"), F.lit(True))
    if mode == "e":
        failed = F.raise_error(F.concat(F.lit("REF mismatch at "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))).cast("boolean")
        return rows.where(F.when(bad, failed).otherwise(True)).select(*df.columns)
    if mode == "w":
        return rows.select(*df.columns, bad.alias("mismatch"))
    if mode == "x":
        return rows.where(~bad).select(*df.columns)
    if mode != "s":
        raise ValueError(f"unknown mode {mode}")
    rows = rows.select(*df.columns, real.alias("_real"))
    at = lambda text, i: F.substring(text, i + 1, F.lit(1))
    cleaned = F.when(_ordinary(F.col("ref")), F.translate("ref", AMBIGUOUS, FIRST_BASE)).otherwise(F.col("ref"))
    rows = rows.withColumn("_ref0", F.when(F.col("ref") == ".", F.col("_real")).otherwise(cleaned))
    unknown = lambda i: (F.upper(at(F.col("_ref0"), i)) == "N") & (at(F.col("_real"), i) != "N")
    known = _by_base(F.col("_ref0"), lambda c, i: F.when(unknown(i), at(F.col("_real"), i)).otherwise(c))
    named = lambda a: _by_base(a, lambda c, i: F.when((F.upper(c) == "N") & unknown(i) & (i < F.length("_ref0")), at(F.col("_real"), i)).otherwise(c))
    has_n = F.upper("_ref0").contains("N") & F.col("_real").isNotNull()
    alts = F.transform("alts", lambda a: F.when(_ordinary(a), F.translate(a, AMBIGUOUS, FIRST_BASE)).otherwise(a))
    rows = rows.withColumns({"_ref": F.when(has_n, known).otherwise(F.col("_ref0")), "_alts": F.when(has_n, F.transform(alts, lambda a: F.when(_ordinary(a), named(a)).otherwise(a))).otherwise(alts)})
    rows = rows.withColumn("_bad", F.coalesce(F.upper("_ref") != F.col("_real"), F.lit(False)))
    place = F.array_position(F.transform("_alts", lambda a: F.when(_ordinary(a), F.upper(a)).otherwise("")), F.col("_real")).cast("int")
    rows = rows.withColumn("_place", F.when(F.col("_bad"), place).otherwise(0))
    swapped = F.transform("_alts", lambda a, i: F.when(i == F.col("_place") - 1, F.col("_ref")).otherwise(a))
    follow = lambda a: _by_base(a, lambda c, i: F.when(F.upper(c) == F.upper(at(F.col("_ref"), i)), at(F.col("_real"), i)).otherwise(c))
    patched = F.transform("_alts", lambda a: F.when(_ordinary(a), follow(a)).otherwise(a))
    rows = rows.withColumns({
        "_ref2": F.when(~F.col("_bad"), F.col("_ref")).when(F.col("_place") > 0, F.get("_alts", F.col("_place") - 1)).otherwise(F.col("_real")),
        "_alts2": F.when(~F.col("_bad"), F.col("_alts")).when(F.col("_place") > 0, swapped).otherwise(patched),
    })
    # per ALT its new number: 0 for those that are REF now
    same = lambda a: F.upper(a) == F.upper("_ref2")
    number = lambda a, i: F.when(same(a), 0).otherwise(F.size(F.filter(F.slice("_alts2", F.lit(1), i + 1), lambda x: ~same(x))))
    rows = rows.withColumn("_map", F.transform("_alts2", number))
    out = {"ref": F.col("_ref2"), "alts": F.filter("_alts2", lambda a: ~same(a))}
    if "samples" in df.columns and "GT" in [f.name for f in df.schema["samples"].dataType.elementType]:
        turned = lambda a: F.when((F.col("_place") > 0) & (a == 0), F.col("_place")).when((F.col("_place") > 0) & (a == F.col("_place")), 0).otherwise(a)
        moved = lambda a: variant.let(turned(a), lambda t: F.when(t > 0, F.get("_map", t - 1)).otherwise(t))
        edited = F.transform("samples", lambda s: s.withField("GT", F.when(s["GT"].isNotNull(), s["GT"].withField("alleles", F.transform(s["GT"]["alleles"], moved)))))
        out["samples"] = F.when(F.col("_bad") | F.exists("_map", lambda m: m == 0), edited).otherwise(F.col("samples"))
        if "info" in df.columns and "AC" in [f.name for f in df.schema["info"].dataType]:
            copies = F.size(F.filter(variant.called(), lambda a: a == 0))
            counts = F.transform("info.AC", lambda c, i: F.when(i == F.col("_place") - 1, copies).otherwise(c))
            out["info"] = F.col("info").withField("AC", F.when((F.col("_place") > 0) & F.col("info.AC").isNotNull(), counts).otherwise(F.col("info.AC")))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def selected(df: DataFrame, header: VariantHeader, step, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """step (DataFrame -> DataFrame) for the records that an expression selects; all others pass through as they are, and are
    not split, joined or compared with those. part of what passes through is 0."""
    from variform.operators.filtering import condition

    site = condition(header, include, exclude).site
    out, rest = step(df.where(site)), df.where(~site)
    if "part" in out.columns and "part" not in rest.columns:
        rest = rest.withColumn("part", F.lit(0))
    return out.unionByName(rest)


# ---------------------------------------------------------------- atoms

def atoms_of(ref: str, alt: str) -> list[tuple[int, str, str]]:
    """(offset, REF, ALT) of an allele's parts: a substitution at every differing base of the common length after the
    shared end is cut, and one insertion or deletion anchored at its last base."""
    ref, alt = ref.upper(), alt.upper()
    while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    common = min(len(ref), len(alt))
    out = [(i, ref[i], alt[i]) for i in range(common) if ref[i] != alt[i]]
    if len(ref) != len(alt) or ref == alt:
        anchor = ref[common - 1]
        out.append((common - 1, anchor + ref[common:], anchor + alt[common:]))
    return out


def atom_rows(ref: str, alts: list[str]) -> list[dict]:
    """The distinct atoms of a record in order, each with the first ALT that has it and what a call of every ALT becomes:
    1 the atom, 2 another one over the same bases ('*'), 0 neither. star: any other atom lies over the same bases."""
    atoms = []
    for k, alt in enumerate(alts, 1):
        own = atoms_of(ref, alt)
        for i, (at, x, y) in enumerate(own):
            # an insertion or deletion whose anchor base is itself substituted goes along with that substitution
            behind = len(x) != len(y) and i > 0 and own[i - 1][0] == at
            atoms.append((at, x, y, behind, k))
    atoms.sort()
    out: list[dict] = []
    for at, x, y, behind, k in atoms:
        if out and (out[-1]["offset"], out[-1]["ref"], out[-1]["alt"]) == (at, x, y):
            continue
        mapping, star = [0] * len(alts), False
        for at2, x2, y2, behind2, k2 in atoms:
            if (at2, x2, y2) == (at, x, y):
                mapping[k2 - 1] = 1
            elif at2 <= at + len(x) - 1 and at <= at2 + len(x2) - 1:
                together = at2 == at and ((behind and len(x2) == 1) or (behind2 and len(x) == 1) or (x2 == x and ((behind and len(y2) == 1) or (behind2 and len(y) == 1))))
                mapping[k2 - 1], star = 1 if together else 2, True
        out.append({"offset": at, "ref": x, "alt": y, "source": k, "mapping": mapping, "star": star})
    return out


_ATOMS = T.ArrayType(
    T.StructType([
        T.StructField("offset", T.IntegerType()), T.StructField("ref", T.StringType()), T.StructField("alt", T.StringType()),
        T.StructField("source", T.IntegerType()), T.StructField("mapping", T.ArrayType(T.IntegerType())), T.StructField("star", T.BooleanType()),
    ])
)


@F.pandas_udf(_ATOMS)
def _atoms_udf(ref: pd.Series, alts: pd.Series) -> pd.Series:
    return pd.Series([atom_rows(r, list(a)) for r, a in zip(ref, alts, strict=True)])


def atomize(df: DataFrame, header: VariantHeader, *, star: bool = True, old_rec_tag: str | None = None) -> tuple[DataFrame, VariantHeader]:
    """One row per primitive (substitution or anchored indel), with part. A call of an ALT that has another atom over the
    same bases becomes '*' (allele 2), or missing without ``star``. Records with other than sequence alleles stay.

    Number=A and R fields take the first ALT that has the atom ('.' for '*'), Number=G fields are dropped from INFO and
    emptied in samples. old_rec_tag: INFO tag for CHR|POS|REF|ALTS|indexes of the original."""
    plain = (F.size("alts") > 0) & F.col("ref").rlike("(?i)^[ACGTN]+$") & F.forall("alts", lambda a: a.rlike("(?i)^[ACGTN]+$"))
    found = F.when(F.col("_plain"), _atoms_udf("ref", F.when(F.col("_plain"), F.col("alts")).otherwise(F.array().cast("array<string>"))))
    rows = df.withColumn("_plain", plain).withColumn("_atoms", found)
    same = (F.size("_atoms") == 1) & (F.size("alts") == 1) & (F.get("_atoms", F.lit(0))["offset"] == 0)
    same = same & (F.get("_atoms", F.lit(0))["ref"] == F.upper("ref")) & (F.get("_atoms", F.lit(0))["alt"] == F.upper(F.get("alts", F.lit(0))))
    rows = rows.withColumn("_keep", F.coalesce(~F.col("_plain") | same | (F.size("_atoms") == 0), F.lit(True)))
    rows = rows.select("*", F.posexplode_outer(F.when(~F.col("_keep"), F.col("_atoms"))).alias("part", "a")).withColumn("part", F.coalesce("part", F.lit(0)))
    cut, allele, starred = ~F.col("_keep"), F.col("a.source"), F.col("a.star") & F.lit(star)

    def laid(v: Column, f: Field) -> Column:
        if f.scalar or f.number not in ("A", "R", "G"):
            return v
        if f.number == "G":
            return F.lit(None).cast(f.spark())
        own = [F.get(v, allele - 1)] if f.number == "A" else [F.get(v, F.lit(0)), F.get(v, allele)]
        wide = F.array(*own, F.lit(None).cast(f.spark()[6:-1]))
        return F.when(v.isNotNull(), F.when(starred, wide).otherwise(F.array(*own)))

    out: dict[str, Column] = {
        "pos": F.when(cut, F.col("pos") + F.col("a.offset")).otherwise(F.col("pos")), "ref": F.when(cut, F.col("a.ref")).otherwise(F.col("ref")),
        "alts": F.when(cut, F.when(starred, F.array("a.alt", F.lit("*"))).otherwise(F.array("a.alt"))).otherwise(F.col("alts")),
    }
    infos = header.infos
    if "info" in df.columns:
        fields = [F.when(cut, laid(F.col("info")[k], f)).otherwise(F.col("info")[k]).alias(k) for k, f in infos.items()]
        if old_rec_tag:
            having = F.array_join(F.transform(F.filter(F.transform("a.mapping", lambda m, i: F.struct(m.alias("m"), (i + 1).alias("i"))), lambda x: x["m"] == 1), lambda x: x["i"].cast("string")), ",")
            origin = F.concat_ws("|", "chrom", F.col("pos").cast("string"), "ref", F.array_join("alts", ","), having)
            infos = infos | {old_rec_tag: Field(old_rec_tag, "1", "String", "Original variant")}
            fields.append(F.when(cut, origin).alias(old_rec_tag))
        out["info"] = F.struct(*fields)
    if "samples" in df.columns:
        over = F.lit(2) if star else F.lit(None).cast("int")
        code = lambda x: F.when(x.isNull() | (x == 0), x).otherwise(F.get("a.mapping", x - 1))
        called = lambda x: F.when(code(x) == 2, over).otherwise(code(x))

        def sample(s: Column) -> Column:
            fields = []
            for k, f in header.formats.items():
                if k == "GT":
                    new = F.when(s[k].isNotNull(), F.struct(F.transform(s[k]["alleles"], called).alias("alleles"), s[k]["phased"].alias("phased")))
                else:
                    new = laid(s[k], f)
                fields.append(F.when(cut, new).otherwise(s[k]).alias(k))
            return F.struct(*fields)

        out["samples"] = F.transform("samples", sample)
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns], "part"), header.with_(infos=infos)
