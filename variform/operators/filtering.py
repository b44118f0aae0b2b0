"""Hard and soft filters, masks, failed genotypes, and gap filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variform.functions import variant
from variform.functions.expression import Truth, compile_truth
from variform.operators import regions
from variform.sources.header import VariantHeader


def _negated(t: Truth) -> Truth:
    return Truth(~t.site, None if t.passes is None else F.transform(t.passes, lambda p: ~p), t.selected)


def condition(header: VariantHeader, include: str | None = None, exclude: str | None = None) -> Truth:
    """Truth of an include or a negated exclude expression; exclusion negates samples without selecting again."""
    if include is not None and exclude is not None:
        raise ValueError("give include or exclude, not both")
    if include is not None:
        return compile_truth(include, header)
    return _negated(compile_truth(exclude, header)) if exclude is not None else Truth(F.lit(True))


def fill_genotype(gt: Column, allele: Column, phased: bool = False) -> Column:
    """The genotype with every allele replaced, its ploidy kept."""
    return F.when(gt["alleles"].isNotNull(), F.struct(F.transform(gt["alleles"], lambda a: allele).alias("alleles"), F.transform(gt["alleles"], lambda a: F.lit(phased)).alias("phased")))


def refresh_counts(df: DataFrame, header: VariantHeader, changed: Column) -> DataFrame:
    """INFO/AC and INFO/AN recomputed where genotypes changed, for those of the two that the record has."""
    if "info" not in df.columns or not {"AC", "AN"} & set(header.infos):
        return df
    alleles = variant.called()
    info = F.col("info")
    if "AC" in header.infos:
        ac = F.slice(variant.allele_counts(F.col("alts"), alleles), 2, F.greatest(F.size("alts"), F.lit(1)))
        info = info.withField("AC", F.when(changed & F.col("info.AC").isNotNull() & (F.size("alts") > 0), ac).otherwise(F.col("info.AC")))
    if "AN" in header.infos:
        info = info.withField("AN", F.when(changed & F.col("info.AN").isNotNull(), F.size(alleles)).otherwise(F.col("info.AN")))
    return df.withColumn("info", info)


def filter_variants(
    df: DataFrame, header: VariantHeader, *, include: str | None = None, exclude: str | None = None, soft: str | None = None, mode: str = "",
    set_genotypes: str | None = None, mask: list[tuple[str, int, int]] | None = None, mask_negate: bool = False, mask_overlap: str = "record",
) -> tuple[DataFrame, VariantHeader]:
    """Filter by an expression and a mask. Without ``soft`` and ``set_genotypes`` failing records are dropped.

    soft: FILTER name, or '+' for the first free FilterN. mode: '' replaces, '+' adds, 'x' resets passing ones, '+x' both.
    set_genotypes: '.' or '0', the allele that failing samples get (all samples where the truth is the record's)."""
    if mask is not None and soft is None:
        raise ValueError("a mask needs a soft filter")
    if mode not in ("", "+", "x", "+x"):
        raise ValueError(f"unknown mode {mode}")
    t = condition(header, include, exclude)
    site = t.site
    if mask is not None:
        hit = regions.overlap(mask, mask_overlap, F.col("info.END") if "END" in header.infos else None)
        site = site & (hit if mask_negate else ~hit)
    staged = variant.bound(df, *variant.mentioned(df, site)).withColumn("_pass", site)
    if t.passes is not None and set_genotypes is not None:
        staged = staged.withColumn("_samples_pass", t.passes)
    filters = F.col("filters")
    passing = F.array(F.lit("PASS")) if "x" in mode else F.when(F.size(filters) == 0, F.array(F.lit("PASS"))).otherwise(filters)
    failing = filters
    if soft is not None:
        name = next(f"Filter{i}" for i in range(1, 1 << 30) if f"Filter{i}" not in header.filters) if soft == "+" else soft
        header = header.with_filter(name, f"Set if {'not ' if include else ''}true: {include or exclude or 'mask'}")
        failing = F.array_union(F.array_remove(filters, "PASS"), F.array(F.lit(name))) if "+" in mode else F.array(F.lit(name))
    staged = staged.withColumn("filters", F.when(F.col("_pass"), passing).otherwise(failing))
    if set_genotypes is not None:
        allele = {".": F.lit(None).cast("int"), "0": F.lit(0)}[set_genotypes]
        failed = F.transform("_samples_pass", lambda p: ~p) if t.passes is not None else F.transform("samples", lambda s: ~F.col("_pass"))
        staged = staged.withColumn("_failed", failed)
        edited = F.zip_with("samples", "_failed", lambda s, f: s.withField("GT", F.when(f, fill_genotype(s["GT"], allele)).otherwise(s["GT"])))
        staged = staged.withColumn("_before", F.col("samples")).withColumn("samples", edited)
        staged = refresh_counts(staged, header, F.to_json("_before") != F.to_json("samples")) if {"AC", "AN"} & set(header.infos) else staged
    elif soft is None:
        staged = staged.where("_pass")
    return staged.select(*df.columns), header


def _in_range_bins(df: DataFrame, reach: Column, width: int) -> DataFrame:
    """Rows once for every bin of ``width`` positions that they reach, so that no window holds a whole contig."""
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(reach / width))))


def snp_gap(df: DataFrame, distance: int, types: str = "indel", width: int = 1 << 16) -> DataFrame:
    """(row_id) of SNPs within ``distance`` of a record of the listed types: end of the earlier + distance >= POS of the later."""
    bits = variant.class_bits(types)
    end = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1 + distance
    rows = df.select("row_id", "chrom", "pos", end.alias("reach"), variant.record_class().alias("mask"))
    rows = rows.where(F.col("mask").bitwiseAND(bits | variant.SNP) != 0)
    rows = _in_range_bins(rows, F.col("reach"), width)
    snp, listed = F.col("mask").bitwiseAND(variant.SNP) != 0, F.col("mask").bitwiseAND(bits) != 0
    # running frames only look back, so a row costs the same however many its bin has: ahead is back in the other order
    w = Window.partitionBy("chrom", "_bin")
    before = w.orderBy("pos", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    after = w.orderBy(F.desc("pos"), F.desc("row_id")).rowsBetween(Window.unboundedPreceding, -1)
    next_listed = F.min(F.when(listed, F.col("pos"))).over(after)
    reached = F.max(F.when(listed, F.col("reach"))).over(before)
    # a later record of a listed type marks the earlier SNP instead of itself
    reached_plain = F.max(F.when(listed & ~snp, F.col("reach"))).over(before)
    marked = snp & ((next_listed <= F.col("reach")) | (F.when(listed, reached_plain).otherwise(reached) >= F.col("pos")))
    return rows.withColumn("m", F.coalesce(marked, F.lit(False))).where("m").select("row_id").distinct()


def first_alt_count(header: VariantHeader) -> Column:
    """INFO/AC of the first ALT where AC and AN are valid, else allele 1 counted in GT; null if neither is there."""
    n_alts = F.size("alts")
    gt = F.size(F.filter(variant.called(), lambda a: a == 1)) if "GT" in header.formats and header.samples else F.lit(None).cast("int")
    if not {"AC", "AN"} <= set(header.infos):
        return gt
    ac, an = F.col("info.AC"), F.col("info.AN")
    usable = (F.size(ac) == n_alts) & ~F.exists(ac, lambda a: a.isNull())
    return F.when(ac.isNotNull() & (an >= 0), F.when(usable, F.get(ac, F.lit(0)))).otherwise(gt)


def _chained(rows: DataFrame, width: int) -> DataFrame:
    """rows (chrom, pos, row_id, until) with chain: a number a contig of the chains, which end where POS lies beyond the until
    of the record before. Bins of ``width`` positions are chained by themselves, then the bins by their ends."""
    rows = rows.withColumn("_bin", F.floor(F.col("pos") / width))
    inside = Window.partitionBy("chrom", "_bin").orderBy("pos", "row_id")
    place = F.struct("pos", "row_id")
    ends = rows.withColumn("_opens", F.coalesce(F.col("pos") > F.lag("until").over(inside), F.lit(False))).groupBy("chrom", "_bin").agg(
        F.sum(F.col("_opens").cast("long")).alias("_n"), F.min_by("pos", place).alias("_first"), F.max_by("until", place).alias("_last")
    )
    # one row a bin
    bins = Window.partitionBy("chrom").orderBy("_bin")
    before = F.lag("_last").over(bins)
    ends = ends.withColumn("_before", before).withColumn("_new", F.coalesce(F.col("_first") > F.col("_before"), F.lit(True)).cast("long"))
    base = F.sum(F.col("_n") + F.col("_new")).over(bins) - F.col("_n")
    ends = ends.withColumn("_base", base).select("chrom", "_bin", "_base")
    opens = F.coalesce(F.col("pos") > F.lag("until").over(inside), F.lit(False))
    counted = rows.withColumn("_opens", opens.cast("long")).withColumn("_local", F.sum("_opens").over(inside))
    return counted.join(ends, ["chrom", "_bin"]).withColumn("chain", F.col("_base") + F.col("_local")).drop("_bin", "_opens", "_local", "_base")


def indel_gap(df: DataFrame, header: VariantHeader, distance: int, width: int = 1 << 16) -> DataFrame:
    """(row_id) of the indels of a chain that are not its best: highest QUAL above 0, else most copies of the first ALT."""
    rows = df.where(variant.record_class().bitwiseAND(variant.INDEL) != 0).select(
        "row_id", "chrom", "pos", (F.col("pos") + F.length("ref") - 1 + distance).alias("until"), "qual", first_alt_count(header).alias("ac")
    )
    rows = _chained(rows, width)
    chain = Window.partitionBy("chrom", "chain")
    ordered = chain.orderBy("pos", "row_id")
    rows = rows.withColumns({
        "n": F.row_number().over(ordered), "first_qual": F.first("qual").over(ordered), "top": F.max("qual").over(chain),
        "by_qual": F.row_number().over(chain.orderBy(F.desc_nulls_last("qual"), "pos", "row_id")),
    })
    ac = F.when(F.col("n") == 1, F.coalesce("ac", F.lit(0))).otherwise(F.coalesce("ac", F.lit(-1)))
    rows = rows.withColumn("ac", ac)
    rows = rows.withColumn("by_ac", F.row_number().over(chain.orderBy(F.desc("ac"), "pos", "row_id")))
    # the first of a chain without QUAL keeps the comparison from ever finding a higher one
    use_qual = F.col("first_qual").isNotNull() & (F.col("top") > 0)
    return rows.where(F.when(use_qual, F.col("by_qual")).otherwise(F.col("by_ac")) > 1).select("row_id")


def gap_filter(df: DataFrame, header: VariantHeader, *, snp: tuple[int, str] | int | None = None, indel: int | None = None, soft: bool = False, require_order: bool = False) -> tuple[DataFrame, VariantHeader]:
    """Gap filters; marked records are dropped, or get SnpGap and IndelGap in FILTER with ``soft``.

    The marks do not depend on the order of rows; require_order fails if row_id does not follow contig and position."""
    if require_order:
        from variform.operators.norm import check_order

        if not (broken := check_order(df).limit(1)).isEmpty():
            raise ValueError(f"records are not sorted: {broken.first().problem}")
    marks = []
    if snp is not None:
        distance, types = snp if isinstance(snp, tuple) else (snp, "indel")
        marks.append(("SnpGap", snp_gap(df, distance, types), f"SNP within {distance} bp of {types}"))
    if indel is not None:
        marks.append(("IndelGap", indel_gap(df, header, indel), f"Indel within {indel} bp of an indel"))
    for name, rows, text in marks:
        if not soft:
            df = df.join(rows, "row_id", "left_anti")
            continue
        header = header.with_filter(name, text)
        marked = rows.withColumn("_marked", F.lit(True))
        df = df.join(marked, "row_id", "left").withColumn("filters", F.when(F.col("_marked"), F.array_union(F.array_remove("filters", "PASS"), F.array(F.lit(name)))).otherwise(F.col("filters"))).drop("_marked")
    return df, header
