"""Genotype editing."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from variform.functions import variant
from variform.functions.expression import compare_numbers, compile_truth
from variform.functions.stats import binom_udf
from variform.operators.ordered import sums_before
from variform.operators.filtering import fill_genotype, refresh_counts
from variform.sources.header import HeaderError, VariantHeader

# Fixed values of the 48-bit linear congruential generator.
MULTIPLIER, INCREMENT, MODULUS_BITS, LOW_SEED = 0x5DEECE66D, 0xB, 48, 0x330E
_MASK = (1 << MODULUS_BITS) - 1


def random_state(seed: int, n: int) -> int:
    """State after n draws: the affine step is raised to the n-th power."""
    state = ((seed & 0xFFFFFFFF) << 16) | LOW_SEED
    mul, add = MULTIPLIER, INCREMENT
    while n:
        if n & 1:
            state = (state * mul + add) & _MASK
        mul, add = mul * mul & _MASK, (add * mul + add) & _MASK
        n >>= 1
    return state


def _draw_udf(seed: int, fraction: float):
    @pandas_udf("array<boolean>")
    def draw(before: pd.Series, chosen: pd.Series) -> pd.Series:
        out = []
        for n, flags in zip(before, chosen, strict=True):
            state, row = random_state(seed, int(n)), []
            for f in flags:
                if f:
                    state = (state * MULTIPLIER + INCREMENT) & _MASK
                row.append(bool(f) and state / 2.0**MODULUS_BITS <= fraction)
            out.append(np.array(row, dtype=bool))
        return pd.Series(out)

    return draw


def draws_before(df: DataFrame, count: Column, chunk: int = 1 << 16) -> DataFrame:
    """df with _before: the sum of count over all rows of a smaller row_id. Chunks of row_id are summed first, so that no
    window holds the whole table."""
    rows = df.withColumn("_count", count.cast("long")).withColumn("_chunk", F.floor(F.col("row_id") / chunk))
    totals = rows.groupBy("_chunk").agg(F.sum("_count").alias("t"))
    upto = sums_before(totals, "_chunk", "t", "_base")
    inside = F.sum("_count").over(Window.partitionBy("_chunk").orderBy("row_id")) - F.col("_count")
    return rows.withColumn("_inside", inside).join(upto, "_chunk").withColumn("_before", F.col("_base") + F.col("_inside")).drop("_chunk", "_count", "_inside", "_base")


def select_target(df: DataFrame, header: VariantHeader, target: str, include: str | None = None, exclude: str | None = None) -> Column:
    """array<boolean>: which samples a target selects ('.', './x', './.', 'a', 'q' or 'b:TAG<CMP>value')."""
    alleles = lambda s: F.coalesce(s["GT"]["alleles"], F.array(F.lit(None).cast("int")))
    if target == "a":
        return F.transform("samples", lambda s: F.lit(True))
    if target in (".", "./x", "./."):
        missing = lambda s: F.exists(alleles(s), lambda a: a.isNull())
        called = lambda s: F.exists(alleles(s), lambda a: a.isNotNull())
        tests = {".": missing, "./x": lambda s: missing(s) & called(s), "./.": lambda s: missing(s) & ~called(s)}
        return F.transform("samples", tests[target])
    if target == "q":
        t = compile_truth(include if include is not None else exclude, header)
        if t.passes is None:
            return F.transform("samples", lambda s: t.site if include is not None else ~t.site)
        if include is not None:
            return t.passes
        chosen = F.array(*[F.lit(x) for x in (t.selected or [True] * len(header.samples))])
        return F.zip_with(t.passes, chosen, lambda p, c: c & ~p)
    m = re.fullmatch(r"b:([^<>=!]+)(<=|>=|<|>|=)(.+)", target)
    if not m:
        raise ValueError(f"unknown target {target}")
    f = header.formats.get(m[1])
    if f is None or f.number != "R" or f.type != "Integer":
        raise HeaderError(f"FORMAT/{m[1]} must be an integer of Number=R")
    het = lambda s: (F.size(s["GT"]["alleles"]) == 2) & (F.get(s["GT"]["alleles"], F.lit(0)) != F.get(s["GT"]["alleles"], F.lit(1)))
    depth = lambda which: F.transform("samples", lambda s: F.when(het(s), F.get(s[m[1]], F.get(s["GT"]["alleles"], F.lit(which))).cast("double")))
    return F.transform(binom_udf(depth(0), depth(1)), lambda p: p.isNotNull() & compare_numbers(m[2], p, F.lit(float(m[3]))))


def _ranked() -> tuple[Column, Column]:
    """Most and second most frequent allele, ties to the lower index; an error without called alleles."""
    counts = variant.allele_counts(F.col("alts"), variant.called())
    order = F.array_sort(F.transform(counts, lambda c, i: F.struct((-c).alias("c"), i.alias("i"))))
    total = F.aggregate(counts, F.lit(0), lambda acc, c: acc + c)
    no_call = F.raise_error(F.lit("major or minor allele cannot be resolved without called alleles")).cast("int")
    single = F.raise_error(F.lit("minor allele requires at least two declared alleles")).cast("int")
    major = F.when(total > 0, F.get(order, F.lit(0))["i"]).otherwise(no_call)
    minor = F.when(total == 0, no_call).when(F.size(counts) < 2, single).otherwise(F.get(order, F.lit(1))["i"])
    return major, minor


def _deepest(s: Column) -> Column:
    """The allele of the largest AD, ties to the lower index; a missing, short, long or negative AD is an error."""
    wrong = F.raise_error(F.lit("FORMAT/AD must have a depth of 0 or more for every allele")).cast("int")
    order = F.array_sort(F.filter(F.transform(s["AD"], lambda d, i: F.struct((-d).alias("d"), i.alias("i"))), lambda x: x["d"].isNotNull()))
    sound = (F.size(s["AD"]) == F.size("alts") + 1) & ~F.exists(s["AD"], lambda d: F.coalesce(d < 0, F.lit(False))) & (F.size(order) > 0)
    return F.when(F.coalesce(sound, F.lit(False)), F.get(order, F.lit(0))["i"]).otherwise(wrong)


def replacement(kind: str, s: Column) -> Column:
    """The new genotype of a sample: . 0 0p m mp M Mp X p u i or c:TEMPLATE."""
    gt = s["GT"]
    a = gt["alleles"]
    if kind in (".", "0", "0p"):
        return fill_genotype(gt, F.lit(None).cast("int") if kind == "." else F.lit(0), kind == "0p")
    if kind in ("m", "mp", "M", "Mp"):
        return fill_genotype(gt, F.col("_minor" if kind[0] == "m" else "_major"), len(kind) == 2)
    if kind == "X":
        return fill_genotype(gt, _deepest(s))
    if kind == "p":
        return F.struct(a.alias("alleles"), F.transform(a, lambda x: F.lit(True)).alias("phased"))
    if kind == "u":
        missing_first = F.array_sort(F.transform(a, lambda x: F.coalesce(x, F.lit(-1))))
        return F.struct(F.transform(missing_first, lambda x: F.when(x >= 0, x)).alias("alleles"), F.transform(a, lambda x: F.lit(False)).alias("phased"))
    if kind == "i":
        second = F.get(gt["phased"], F.lit(1))
        return F.when(F.size(a) == 2, F.struct(F.reverse(a).alias("alleles"), F.array(second, second).alias("phased"))).otherwise(gt)
    if not kind.startswith("c:"):
        raise ValueError(f"unknown replacement {kind}")
    parts = re.split(r"([/|])", kind[2:])
    terms, seps = parts[::2], parts[1::2]
    if not all(re.fullmatch(r"\.|m|M|X|\d+", t) for t in terms):
        raise ValueError(f"bad template {kind}")
    known = {".": F.lit(None).cast("int"), "m": F.col("_minor"), "M": F.col("_major"), "X": _deepest(s)}
    allele = lambda t: known[t] if t in known else F.when(F.lit(int(t)) <= F.size("alts"), F.lit(int(t)))
    phased = [True] if not seps else [x == "|" for x in [seps[0], *seps]]
    return F.struct(F.array(*[allele(t) for t in terms]).alias("alleles"), F.array(*[F.lit(p) for p in phased]).alias("phased"))


def set_genotypes(
    df: DataFrame, header: VariantHeader, target: str, new: str, *, include: str | None = None, exclude: str | None = None, fraction: float | None = None, seed: int = 0,
) -> DataFrame:
    """Replace the genotypes a target selects; ``fraction`` keeps each selected one with that chance, drawn in stream order.

    AC and AN of records that have them follow. A missing genotype that is selected becomes '.'."""
    gt = header.formats.get("GT")
    if gt is None:
        raise HeaderError("FORMAT/GT is not declared")
    if (new == "X" or (new.startswith("c:") and "X" in new)) and "AD" not in header.formats:
        raise HeaderError("FORMAT/AD is not declared")
    if new == "X" or (new.startswith("c:") and "X" in new):
        ad = header.formats["AD"]
        if (ad.number, ad.type) != ("R", "Integer"):
            raise HeaderError("FORMAT/AD must be an integer of Number=R")
    out = df.withColumn("_chosen", select_target(df, header, target, include, exclude))
    if fraction is not None:
        if not 0 < fraction < 1:
            raise ValueError("the fraction lies between 0 and 1")
        out = draws_before(out, F.size(F.filter("_chosen", lambda c: c)))
        out = out.withColumn("_chosen", _draw_udf(seed, fraction)("_before", "_chosen")).drop("_before")
    needs_rank = re.search(r"[mM]", new) is not None
    if needs_rank:
        major, minor = _ranked()
        some = F.exists("_chosen", lambda c: c)
        out = out.withColumn("_major", F.when(some, major)).withColumn("_minor", F.when(some, minor) if "m" in new else F.lit(None).cast("int"))
        # the replacement stands within loops over samples and alleles, which would rank again every time
        out = variant.bound(out, "_chosen", "_major", "_minor")
    dot = F.struct(F.array(F.lit(None).cast("int")).alias("alleles"), F.array(F.lit(False)).alias("phased"))
    held = F.transform("samples", lambda s: s.withField("GT", F.coalesce(s["GT"], dot)))
    edited = F.zip_with(held, "_chosen", lambda s, c: s.withField("GT", F.when(c, replacement(new, s)).otherwise(s["GT"])))
    out = out.withColumn("samples", edited)
    return refresh_counts(out, header, F.exists("_chosen", lambda c: c)).select(*df.columns)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(genotypes, alleles) changed between two versions of the same rows."""
    pair = before.select("row_id", F.col("samples").alias("b")).join(after.select("row_id", F.col("samples").alias("a")), "row_id")
    both = F.arrays_zip("b", "a")
    differ = F.filter(both, lambda p: ~p["b"]["GT"].eqNullSafe(p["a"]["GT"]))
    alleles = F.aggregate(
        F.transform(both, lambda p: F.size(F.filter(F.zip_with(p["b"]["GT"]["alleles"], p["a"]["GT"]["alleles"], lambda x, y: ~x.eqNullSafe(y)), lambda t: t))), F.lit(0), lambda acc, n: acc + n
    )
    return pair.agg(F.sum(F.size(differ)).alias("genotypes"), F.sum(alleles).alias("alleles"))
