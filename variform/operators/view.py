"""Record and sample selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variform.functions import variant
from variform.sources.header import Field, HeaderError, VariantHeader


def select_records(
    df: DataFrame, *, filters: list[str] | None = None, known: bool | None = None, types: str | None = None, exclude_types: str | None = None,
    min_alleles: int | None = None, max_alleles: int | None = None,
) -> DataFrame:
    """FILTER any-of ('.' = none), known or novel IDs, variant classes, and bounds on REF + ALT alleles."""
    test: list[Column] = []
    if filters is not None:
        held = F.arrays_overlap("filters", F.array(*[F.lit(f) for f in filters]))
        test.append(F.coalesce(held, F.lit(False)) | ((F.size("filters") == 0) if "." in filters else F.lit(False)))
    if known is not None:
        test.append((F.size("ids") > 0) if known else (F.size("ids") == 0))
    mask = variant.record_class()
    if types:
        test.append(mask.bitwiseAND(variant.class_bits(types)) != 0)
    if exclude_types:
        test.append(mask.bitwiseAND(variant.class_bits(exclude_types)) == 0)
    for bound in (min_alleles, max_alleles):
        if bound is not None and bound < 1:
            raise ValueError("allele bounds start at one")
    if min_alleles is not None and max_alleles is not None and min_alleles > max_alleles:
        raise ValueError("min_alleles exceeds max_alleles")
    n = F.size("alts") + 1
    if min_alleles is not None:
        test.append(n >= min_alleles)
    if max_alleles is not None:
        test.append(n <= max_alleles)
    for t in test:
        df = df.where(t)
    return df


def sample_indexes(header: VariantHeader, samples: list[str], exclude: bool = False, force: bool = False) -> list[int]:
    """Places of the samples in requested order (exclusion keeps header order)."""
    unknown = [s for s in samples if s not in header.samples]
    if unknown and not force:
        raise HeaderError(f"unknown sample {unknown[0]}")
    samples = [s for s in samples if s in header.samples]
    if len(set(samples)) != len(samples):
        raise HeaderError("duplicate sample name")
    if exclude:
        return [i for i, s in enumerate(header.samples) if s not in samples]
    return [header.samples.index(s) for s in samples]


def with_counts(df: DataFrame, header: VariantHeader) -> tuple[DataFrame, VariantHeader]:
    """INFO/AC and INFO/AN recomputed from GT; AC is removed where there is no ALT."""
    alleles = variant.called()
    ac = F.when(F.size("alts") > 0, F.slice(variant.allele_counts(F.col("alts"), alleles), 2, F.greatest(F.size("alts"), F.lit(1))))
    an = F.size(alleles)
    header = header.with_(infos=header.infos | {"AC": Field("AC", "A", "Integer", "Allele count in genotypes"), "AN": Field("AN", "1", "Integer", "Total number of alleles in called genotypes")})
    if "info" in df.columns:
        return df.withColumn("info", F.col("info").withField("AC", ac).withField("AN", an)), header
    return df.withColumn("info", F.struct(ac.alias("AC"), an.alias("AN"))), header


def select_samples(
    df: DataFrame, header: VariantHeader, samples: list[str], *, exclude: bool = False, force: bool = False, update: bool = True, drop_genotypes: bool = False,
) -> tuple[DataFrame, VariantHeader]:
    """Sample projection; AC and AN follow unless update is off, and before genotypes are dropped."""
    places = sample_indexes(header, samples, exclude, force)
    df = df.withColumn("samples", F.array(*[F.get("samples", F.lit(i)) for i in places]) if places else F.slice("samples", 1, 0))
    header = header.with_(samples=tuple(header.samples[i] for i in places))
    if update and "GT" in header.formats:
        df, header = with_counts(df, header)
    return drop_samples(df, header) if drop_genotypes else (df, header)


def drop_samples(df: DataFrame, header: VariantHeader) -> tuple[DataFrame, VariantHeader]:
    """Without genotypes: FORMAT definitions and samples go."""
    return df.drop("samples"), header.with_(samples=(), formats={})


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n records in input order."""
    return df.orderBy("row_id").limit(n)


def head_lines(df: DataFrame, header: VariantHeader, records: int = 0, header_lines: int | None = None, from_chrom: bool = False) -> DataFrame:
    """(line, value): the first header_lines lines of the header (all if None; from_chrom: the #CHROM line too, if it is not
    among them), then the first records as text."""
    from variform.functions.projection import Projection  # which takes sample selection from here

    lines = header.lines()
    taken = lines if header_lines is None else lines[:header_lines]
    lines = [*taken, lines[-1]] if from_chrom and len(taken) < len(lines) else taken
    top = df.sparkSession.createDataFrame(list(enumerate(lines, 1)), "line long, value string")
    if not records:
        return top
    # so few rows that one task may number them
    numbered = head(df, records).withColumn("line", F.row_number().over(Window.orderBy("row_id")) + len(lines))
    return top.unionByName(numbered.select(F.col("line").cast("long").alias("line"), Projection("", header).line().alias("value")))


def contig_stats(df: DataFrame, header: VariantHeader, all_contigs: bool = False) -> DataFrame:
    """(contig_idx, chrom, length, records) by contig; contigs without records only on request."""
    rows = [(i, c, int(f["length"]) if f.get("length", "").isdigit() else None) for i, (c, f) in enumerate(header.contigs.items())]
    contigs = df.sparkSession.createDataFrame(rows, "contig_idx int, chrom string, length int")
    counts = df.groupBy("chrom").agg(F.count("*").alias("records"))
    out = contigs.join(counts, "chrom", "left" if all_contigs else "inner")
    return out.select("contig_idx", "chrom", "length", F.coalesce("records", F.lit(0).cast("long")).alias("records"))


def index_end(header: VariantHeader) -> Column:
    """Last position an index would cover: the longest of REF, SVLEN of CNV, DEL, DUP or INV and FORMAT/LEN of <*>, or END beyond POS."""
    length = F.length("ref")
    if "SVLEN" in header.infos:
        sv = F.exists("alts", lambda a: a.rlike("^<(CNV|DEL|DUP|INV)[:>]"))
        value = F.col("info.SVLEN") if header.infos["SVLEN"].scalar else F.array_max(F.transform("info.SVLEN", lambda v: F.abs(v)))
        length = F.greatest(length, F.when(sv, F.abs(value)))
    if "LEN" in header.formats:
        block = F.exists("alts", lambda a: a.isin("<*>", "<NON_REF>"))
        length = F.greatest(length, F.when(block, F.array_max(F.transform("samples", lambda s: s["LEN"]))))
    end = F.col("pos") + length - 1
    return F.when(F.col("info.END") > F.col("pos"), F.col("info.END")).otherwise(end) if "END" in header.infos else end
