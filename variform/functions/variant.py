"""Classes, spans and genotype counts of variant rows, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNP, MNP, INDEL, OTHER, BND, OVERLAP, REF = 1, 2, 4, 8, 16, 32, 64
# Class names as users write them, and as %TYPE prints them.
CLASS_NAMES = {
    "snp": SNP, "snps": SNP, "mnp": MNP, "mnps": MNP, "indel": INDEL, "indels": INDEL, "other": OTHER, "bnd": BND, "overlap": OVERLAP, "ref": REF,
}
PRINTED = [("SNP", SNP), ("MNP", MNP), ("INDEL", INDEL), ("OTHER", OTHER), ("BND", BND), ("OVERLAP", OVERLAP)]


def class_bits(names: str | list[str]) -> int:
    out = 0
    for name in names.split(",") if isinstance(names, str) else names:
        if name.lower() not in CLASS_NAMES:
            raise ValueError(f"unknown variant type {name}")
        out |= CLASS_NAMES[name.lower()]
    return out


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix (a back reference finds it in one match)."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("\x01"), b), "^([^\x01]*)[^\x01]*\x01\\1", 1))


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def allele_class(ref: Column, alt: Column) -> Column:
    """Class bit of one ALT against REF."""
    return let(F.struct(F.upper(ref).alias("r"), F.upper(alt).alias("a"), alt.alias("raw")), _class)


def _class(x: Column) -> Column:
    r, a = x["r"], x["a"]
    both_one = (F.length(r) == 1) & (F.length(a) == 1)
    return (
        F.when(a == "*", OVERLAP)
        .when(both_one, F.when(a.isin(".", "X") | (r == a), REF).otherwise(SNP))
        .when(a.startswith("<"), F.when(a.startswith("<X>") | a.startswith("<*>") | (x["raw"] == "<NON_REF>"), REF).otherwise(OTHER))
        .when(F.substring(a, 1, 1).isin("[", "]"), BND)
        .otherwise(let(common_prefix(r, a), lambda p: let(F.struct(F.substring(r, p + 1, F.length(r)).alias("r"), F.substring(a, p + 1, F.length(a)).alias("a")), _behind_prefix)))
    )


def _behind_prefix(x: Column) -> Column:
    r, a = x["r"], x["a"]
    # at least one base stays on either side when the common suffix goes
    cut = F.least(common_prefix(F.reverse(r), F.reverse(a)), F.length(r) - 1, F.length(a) - 1)

    def spans(y: Column) -> Column:
        nr, na = y["r"], y["a"]
        one_sided = F.when(F.substring(r, nr, F.lit(1)) == F.substring(a, na, F.lit(1)), INDEL).otherwise(OTHER)
        return F.when(na == 1, F.when(nr == 1, SNP).otherwise(one_sided)).when(nr == 1, one_sided).when(nr == na, MNP).otherwise(OTHER)

    return (
        F.when((r == "") & (a != ""), F.when(F.substring(a, -1, 1).isin("[", "]"), BND).otherwise(INDEL))
        .when((a == "") & (r != ""), INDEL)
        .when((a == "") & (r == ""), REF)
        .when(F.substring(a, 1, 1).isin("[", "]"), BND)
        .otherwise(let(cut, lambda s: let(F.struct((F.length(r) - s).alias("r"), (F.length(a) - s).alias("a")), spans)))
    )


def record_class(ref: Column | str = "ref", alts: Column | str = "alts") -> Column:
    """Union of the classes of all ALTs; REF without one."""
    ref, alts = (F.col(c) if isinstance(c, str) else c for c in (ref, alts))
    return F.when(F.size(alts) == 0, REF).otherwise(F.aggregate(alts, F.lit(0), lambda acc, a: acc.bitwiseOR(allele_class(ref, a))))


def type_text(mask: Column) -> Column:
    """Comma-joined printed names, or REF."""
    def text(m: Column) -> Column:
        named = F.array_join(F.array_compact(F.array(*[F.when(m.bitwiseAND(bit) != 0, name) for name, bit in PRINTED])), ",")
        return let(named, lambda t: F.when(t == "", "REF").otherwise(t))

    return let(mask, text)


def mentioned(df: DataFrame, *conditions: Column) -> list[str]:
    """The columns of df that conditions read."""
    found = df.select(*conditions)._jdf.queryExecution().analyzed().references().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().name())
    return [c for c in df.columns if c in names]


def bound(df: DataFrame, *names: str) -> DataFrame:
    """df with columns that are evaluated once a row, however often a filter above mentions them.

    The optimizer moves a filter below the projection that makes a column and puts the column's whole expression in place
    of every mention. A column that is read from a table has no expression and is left alone, so that reads are pruned."""
    names = [n for n in names if n in df.columns]
    if not names:
        return df
    made, todo = set(), [df.select(*names)._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("Project", "Aggregate", "Generate", "MapInArrow", "Window"):
            text = node.simpleString(1 << 20)
            made |= {n for n in names if f" AS {n}#" in text}
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    if not made:
        return df
    if len(made) == 1:
        return df.select(*[F.explode(F.array(c)).alias(c) if c in made else F.col(c) for c in df.columns])
    held = F.explode(F.array(F.struct(*[c for c in df.columns if c in made]))).alias("_bound")
    out = df.select(*[c for c in df.columns if c not in made], held)
    return out.select(*[F.col("_bound")[c].alias(c) if c in made else F.col(c) for c in df.columns])


def called(samples: Column | str = "samples") -> Column:
    """All called allele indexes of a record."""
    samples = F.col(samples) if isinstance(samples, str) else samples
    return F.filter(F.flatten(F.transform(samples, lambda s: F.coalesce(s["GT"]["alleles"], F.array().cast("array<int>")))), lambda a: a.isNotNull())


def allele_counts(alts: Column, alleles: Column) -> Column:
    """Counts of REF and every ALT among called alleles; an index beyond the ALTs is an error."""
    n = F.size(alts)

    def count(c: Column) -> Column:
        beyond = F.raise_error(F.lit("genotype allele index exceeds the ALT alleles")).cast("array<int>")
        counts = F.transform(F.sequence(F.lit(0), n), lambda i: F.size(F.filter(c, lambda a: a == i)))
        return F.when(F.coalesce(F.array_max(c), F.lit(0)) > n, beyond).otherwise(counts)

    return let(alleles, count)


def ac_text(alts: Column, counts: Column) -> Column:
    """Comma-joined ALT counts; null without an ALT."""
    return F.when(F.size(alts) > 0, F.array_join(F.slice(counts, 2, F.greatest(F.size(alts), F.lit(1))).cast("array<string>"), ","))


def gt_text(gt: Column) -> Column:
    """Spelling of a genotype: 0/1, .|1; '.' if there is none."""
    body = F.zip_with(gt["alleles"], gt["phased"], lambda a, p: F.concat(F.when(F.coalesce(p, F.lit(False)), "|").otherwise("/"), F.coalesce(a.cast("string"), F.lit("."))))
    # from the second character on, without a second mention of the text for its length
    return F.coalesce(F.when(F.size(gt["alleles"]) > 0, F.substring(F.array_join(body, ""), 2, 1 << 30)), F.lit("."))


def end_pos(info_end: Column | None = None) -> Column:
    """Last position: INFO/END, else POS + length(REF) - 1."""
    own = F.col("pos") + F.length("ref") - 1
    return own if info_end is None else F.coalesce(info_end, own)
