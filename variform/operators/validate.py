"""Validation of headers and records: diagnostics as rows, and a one-row report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.functions import variant
from variform.sources.header import FIXED, VariantHeader, parse_map

# Reserved definitions (Number, Type) and value bounds.
RESERVED_INFO = {
    "AA": ("1", "String"), "AC": ("A", "Integer"), "AD": ("R", "Integer"), "AF": ("A", "Float"), "AN": ("1", "Integer"), "BQ": ("1", "Float"), "CIGAR": ("A", "String"),
    "DB": ("0", "Flag"), "DP": ("1", "Integer"), "END": ("1", "Integer"), "H2": ("0", "Flag"), "H3": ("0", "Flag"), "MQ": ("1", "Float"), "MQ0": ("1", "Integer"),
    "NS": ("1", "Integer"), "SB": ("4", "Integer"), "SOMATIC": ("0", "Flag"), "VALIDATED": ("0", "Flag"),
}
RESERVED_FORMAT = {
    "AD": ("R", "Integer"), "DP": ("1", "Integer"), "EC": ("A", "Integer"), "FT": ("1", "String"), "GL": ("G", "Float"), "GP": ("G", "Float"), "GQ": ("1", "Integer"),
    "GT": ("1", "String"), "HQ": ("2", "Integer"), "MQ": ("1", "Integer"), "PL": ("G", "Integer"), "PQ": ("1", "Integer"), "PS": ("1", "Integer"),
}
NON_NEGATIVE = {"AC", "AN", "DP", "END", "MQ0", "NS"}
UNIT_INTERVAL = {"AF", "GP"}
SVCLAIM = {"DEL": {"D", "J", "DJ"}, "DUP": {"D", "J", "DJ"}, "CNV": {"D", "."}, "INV": {"J", "DJ", "."}, "INS": {"J", "DJ", "."}, "BND": {"J", "."}}


def validate_header(text: str) -> list[tuple[int, str, str]]:
    """(line, code, message) of a header's problems, in line order."""
    out: list[tuple[int, str, str]] = []
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    else:
        out.append((len(lines), "header.newline", "the last line has no line feed"))
    m = re.fullmatch(r"##fileformat=VCFv4\.(\d)\r?", lines[0]) if lines else None
    if not lines or not lines[0].startswith("##fileformat="):
        out.append((1, "header.fileformat", "the first line must be ##fileformat"))
    elif not m or not 1 <= int(m[1]) <= 5:
        out.append((1, "header.version", "version must be VCFv4.1 to VCFv4.5"))
    minor = int(m[1]) if m else 3
    seen: set[tuple[str, str]] = set()
    columns_at = None
    for n, line in enumerate(lines, 1):
        line = line.rstrip("\r")
        if line.startswith("##"):
            if columns_at:
                out.append((n, "header.meta-after-columns", "meta line after #CHROM"))
            key, eq, value = line[2:].partition("=")
            if not eq:
                out.append((n, "header.meta-syntax", "key=value expected"))
                continue
            if not key:
                out.append((n, "header.meta-key", "empty key"))
            if not value:
                out.append((n, "header.meta-value", "empty value"))
            if key in ("INFO", "FORMAT", "FILTER", "ALT", "contig") and value:
                out += _definition(n, key, value, minor, seen)
        elif line.startswith("#"):
            if columns_at:
                out.append((n, "header.duplicate-columns", "second #CHROM line"))
            columns_at = n
            cols = line[1:].split("\t")
            if cols[:8] != FIXED:
                out.append((n, "header.fixed-columns", "wrong fixed columns"))
            if len(cols) > 8 and cols[8] != "FORMAT":
                out.append((n, "header.format-column", "the ninth column must be FORMAT"))
            if len(cols) == 9:
                out.append((n, "header.samples", "FORMAT without samples"))
            names = cols[9:]
            if any(not s for s in names):
                out.append((n, "header.sample-name", "empty sample name"))
            if len(set(names)) != len(names):
                out.append((n, "header.duplicate-sample", "duplicate sample name"))
        elif columns_at is None:
            out.append((n, "header.record-before-columns", "record before #CHROM"))
            break
        else:
            break
    if columns_at is None:
        out.append((len(lines), "header.missing-columns", "no #CHROM line"))
    return out


def _definition(n: int, key: str, value: str, minor: int, seen: set) -> list[tuple[int, str, str]]:
    out = []
    if not (value.startswith("<") and value.endswith(">")):
        return [(n, "header.map-syntax", f"{key} needs <...>")]
    fields = parse_map(value)
    name = fields.get("ID")
    if not name:
        return [(n, "header.required-field", f"{key} without ID")]
    if (key, name) in seen and key != "contig":
        out.append((n, "header.duplicate-definition", f"{key}/{name} is repeated"))
    seen.add((key, name))
    if key in ("INFO", "FORMAT", "FILTER", "ALT") and "Description" not in fields:
        out.append((n, "header.required-field", f"{key}/{name} without Description"))
    if key in ("INFO", "FORMAT"):
        number, kind = fields.get("Number"), fields.get("Type")
        letters = {"A", "R", "G", "."} | ({"P"} if key == "FORMAT" and minor >= 4 else set()) | ({"LA", "LR", "LG", "M"} if key == "FORMAT" and minor >= 5 else set())
        types = {"Integer", "Float", "Character", "String"} | ({"Flag"} if key == "INFO" else set())
        if number is None or kind is None:
            out.append((n, "header.required-field", f"{key}/{name} needs Number and Type"))
            return out
        if not (number in letters or number.isdigit()):
            out.append((n, "header.number", f"bad Number {number}"))
        if kind not in types:
            out.append((n, "header.type", f"bad Type {kind}"))
        if (number == "0") != (kind == "Flag"):
            out.append((n, "header.number-zero", "Number=0 belongs to flags alone"))
        reserved = (RESERVED_INFO if key == "INFO" else RESERVED_FORMAT).get(name)
        if reserved and reserved != (number, kind):
            out.append((n, "header.reserved-definition", f"{key}/{name} is reserved as Number={reserved[0]}, Type={reserved[1]}"))
        if not re.fullmatch(r"[A-Za-z_][0-9A-Za-z_.]*|1000G", name):
            out.append((n, "header.id", f"bad ID {name}"))
    if key == "ALT" and name.split(":")[0] not in {"DEL", "INS", "DUP", "INV", "CNV", "BND", "*", "NON_REF"}:
        out.append((n, "header.alt-id", f"bad ALT ID {name}"))
    if key == "contig" and "length" in fields and not (fields["length"].isdigit() and int(fields["length"]) > 0):
        out.append((n, "header.contig-length", "length must be positive"))
    return out


def _issue(test: Column, code: str, field: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))


def _repeated(arr: Column) -> Column:
    return F.size(F.array_distinct(arr)) < F.size(arr)


def record_issues(header: VariantHeader, require_evidence: bool = False) -> Column:
    """array<struct<code, field>>: the problems of a record by itself."""
    breakend = r"[\[\]][^\[\]]+:\d+[\[\]]"
    alt = rf"^(?:[ACGTNacgtn]+|\*|\.[ACGTNacgtn]+|[ACGTNacgtn]+\.|<[^<>\s]+>|[ACGTNacgtn]*{breakend}|{breakend}[ACGTNacgtn]*)$"
    tests = [
        _issue(~F.col("chrom").rlike(r"^(?:<[^<>]+>|[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*)$"), "record.chrom", "CHROM"),
        _issue((F.col("pos") < 0), "record.pos", "POS"),
        _issue(_repeated(F.col("ids")), "record.duplicate-id", "ID"),
        _issue(F.exists("ids", lambda i: i.rlike(r"\s|^$")), "record.id", "ID"),
        _issue(~F.col("ref").rlike("^[ACGTNacgtn]+$"), "record.ref", "REF"),
        _issue(F.exists("alts", lambda a: ~a.rlike(alt)), "record.alt", "ALT"),
        _issue(_repeated(F.transform("alts", lambda a: F.upper(a))), "record.duplicate-alt", "ALT"),
        _issue(F.col("qual") < 0, "record.qual", "QUAL"),
        _issue(_repeated(F.col("filters")), "record.duplicate-filter", "FILTER"),
        _issue(F.exists("filters", lambda f: f.rlike(r"\s|^0$|^$")) | (F.array_contains("filters", "PASS") & (F.size("filters") > 1)), "record.filter", "FILTER"),
    ]
    n_alts = F.size("alts")
    for k, f in header.infos.items():
        v = F.col("info")[k]
        tests += _values(v, f, f"INFO/{k}", n_alts, None)
        if k == "END":
            length = F.lit(None).cast("int")
            for name, fields in header.contigs.items():
                if fields.get("length", "").isdigit():
                    length = F.when(F.col("chrom") == name, int(fields["length"])).otherwise(length)
            tests.append(_issue(v > length, "record.contig-bound", "INFO/END"))
    bounded = F.lit(None).cast("int")
    for name, fields in header.contigs.items():
        if fields.get("length", "").isdigit():
            bounded = F.when(F.col("chrom") == name, int(fields["length"])).otherwise(bounded)
    tests.append(_issue(F.col("pos") > bounded + 1, "record.contig-bound", "POS"))
    if header.samples and header.formats:
        tests.append(_issue(F.size("samples") > len(header.samples), "record.sample-width", "FORMAT"))
        if "GT" in header.formats:
            beyond = F.exists("samples", lambda s: F.exists(F.coalesce(s["GT"]["alleles"], F.array().cast("array<int>")), lambda a: a > n_alts))
            tests.append(_issue(beyond, "record.genotype-allele", "FORMAT/GT"))
        for k, f in header.formats.items():
            if k == "GT":
                continue
            ploidy = (lambda s: F.coalesce(F.size(s["GT"]["alleles"]), F.lit(2))) if "GT" in header.formats else (lambda s: F.lit(2))
            # a HOF test gives one issue a field, however many samples have it
            for kind in ("cardinality", "value-range"):
                def bad(s: Column, k=k, f=f, kind=kind, ploidy=ploidy) -> Column:
                    return _bad(s[k], f, kind, n_alts, ploidy(s))

                tests.append(_issue(F.exists("samples", _one_arg(bad)), f"record.{kind}", f"FORMAT/{k}"))
    if _minor(header) >= 4:
        tests += _structural(header)
    if require_evidence:
        tests.append(_issue(~evidence(header), "record.evidence", "INFO"))
    return F.array_compact(F.array(*tests))


def _one_arg(f):
    return lambda s: F.coalesce(f(s), F.lit(False))


def _minor(header: VariantHeader) -> int:
    m = re.fullmatch(r"VCFv4\.(\d)", header.version)
    return int(m[1]) if m else 3


def _bad(v: Column, f, kind: str, n_alts: Column, ploidy: Column | None) -> Column:
    if kind == "cardinality":
        if f.scalar:
            return F.lit(False)
        want = {"A": n_alts, "R": n_alts + 1}.get(f.number) if not f.number.isdigit() else F.lit(int(f.number))
        if f.number == "G" and ploidy is not None:
            want = F.when(ploidy == 1, n_alts + 1).when(ploidy == 2, F.floor((n_alts + 1) * (n_alts + 2) / 2).cast("int"))
        if want is None:
            return F.lit(False)
        whole_missing = (F.size(v) == 1) & F.get(v, F.lit(0)).isNull()
        return v.isNotNull() & (F.size(v) > 0) & ~whole_missing & (F.size(v) != want)
    if f.id in NON_NEGATIVE and f.type == "Integer":
        return v < 0 if f.scalar else F.exists(v, lambda x: x < 0)
    if f.id in UNIT_INTERVAL and f.type == "Float":
        return ~v.between(0, 1) if f.scalar else F.exists(v, lambda x: ~x.between(0, 1))
    return F.lit(False)


def _values(v: Column, f, name: str, n_alts: Column, ploidy: Column | None) -> list[Column]:
    return [_issue(_bad(v, f, "cardinality", n_alts, ploidy), "record.cardinality", name), _issue(_bad(v, f, "value-range", n_alts, ploidy), "record.value-range", name)]


def _structural(header: VariantHeader) -> list[Column]:
    """Rules from version 4.4 on: symbolic alleles need SVLEN, and SVCLAIM values fit the type."""
    out = []
    symbolic = F.exists("alts", lambda a: a.rlike("^<(DEL|INS|DUP|INV|CNV)[:>]"))
    svlen = F.col("info.SVLEN").isNotNull() if "SVLEN" in header.infos else F.lit(False)
    out.append(_issue(symbolic & ~svlen, "record.svlen-required", "INFO/SVLEN"))
    if "SVCLAIM" in header.infos:
        f = header.infos["SVCLAIM"]
        claims = F.array(F.col("info.SVCLAIM")) if f.scalar else F.col("info.SVCLAIM")
        for kind, allowed in SVCLAIM.items():
            of_kind = F.zip_with("alts", claims, lambda a, c: a.rlike(f"^<{kind}[:>]") & ~F.coalesce(c, F.lit(".")).isin(*allowed))
            out.append(_issue(F.exists(of_kind, lambda x: F.coalesce(x, F.lit(False))), "record.svclaim", f"INFO/SVCLAIM:{kind}"))
    return out


def evidence(header: VariantHeader) -> Column:
    """Whether a record has genotypes, INFO/AF, or INFO/AC with INFO/AN."""
    out = F.lit(False)
    if "GT" in header.formats and header.samples:
        out = out | F.exists("samples", lambda s: F.coalesce(s["GT"]["alleles"].isNotNull(), F.lit(False)))
    if "AF" in header.infos:
        out = out | F.col("info.AF").isNotNull()
    if {"AC", "AN"} <= set(header.infos):
        out = out | (F.col("info.AC").isNotNull() & F.col("info.AN").isNotNull())
    return out


def validate_records(df: DataFrame, header: VariantHeader, require_evidence: bool = False) -> DataFrame:
    """(row_id, code, field) of all problems within records."""
    return df.select("row_id", F.inline(record_issues(header, require_evidence)))


def trimmed_key() -> Column:
    """struct<p, r, a>: position, REF and first ALT with the common end, then the common start, cut away (one base stays)."""
    alleles = F.struct(F.col("pos").alias("p"), F.upper("ref").alias("r"), F.upper(F.coalesce(F.get("alts", F.lit(0)), F.lit("."))).alias("a"))

    def end_cut(x: Column) -> Column:
        n = F.least(variant.common_prefix(F.reverse(x["r"]), F.reverse(x["a"])), F.length(x["r"]) - 1, F.length(x["a"]) - 1)
        return variant.let(n, lambda k: F.struct(x["p"].alias("p"), F.substring(x["r"], F.lit(1), F.length(x["r"]) - k).alias("r"), F.substring(x["a"], F.lit(1), F.length(x["a"]) - k).alias("a")))

    def start_cut(x: Column) -> Column:
        n = F.least(variant.common_prefix(x["r"], x["a"]), F.length(x["r"]) - 1, F.length(x["a"]) - 1)
        return variant.let(n, lambda k: F.struct((x["p"] + k).alias("p"), F.substring(x["r"], k + 1, F.length(x["r"])).alias("r"), F.substring(x["a"], k + 1, F.length(x["a"])).alias("a")))

    # where either is one base nothing can be cut, which is nearly everywhere
    cuttable = lambda x: (F.length(x["r"]) > 1) & (F.length(x["a"]) > 1) & x["r"].rlike("^[ACGTN]+$") & x["a"].rlike("^[ACGTN]+$")
    return variant.let(alleles, lambda x: F.when(cuttable(x), variant.let(end_cut(x), start_cut)).otherwise(x))


def duplicate_variants(df: DataFrame) -> DataFrame:
    """(row_id, code, field) of ALTs that an earlier record has too, after trimming."""
    one = df.select("row_id", "chrom", "pos", "ref", F.explode("alts").alias("a")).withColumn("alts", F.array("a"))
    keyed = one.select("row_id", "chrom", trimmed_key().alias("k")).select("row_id", "chrom", "k.*")
    first = keyed.groupBy("chrom", "p", "r", "a").agg(F.min("row_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    later = keyed.join(first, ["chrom", "p", "r", "a"]).where(F.col("row_id") > F.col("first")).select("row_id").distinct()
    return later.select("row_id", F.lit("record.duplicate-variant").alias("code"), F.lit("ALT").alias("field"))


def validate(df: DataFrame, header: VariantHeader, require_evidence: bool = False) -> DataFrame:
    """(row_id, code, field): record rules, input order and duplicates."""
    from variform.operators.norm import check_order

    order = check_order(df).select("row_id", F.concat(F.lit("record."), "problem").alias("code"), F.lit("POS").alias("field"))
    return validate_records(df, header, require_evidence).unionByName(order).unionByName(duplicate_variants(df))


def report(df: DataFrame, header: VariantHeader, max_diagnostics: int = 100, require_evidence: bool = False) -> DataFrame:
    """One row: version, records, errors, shown and whether the list was cut.

    One pass over the whole records counts them and their own problems; order and duplicates read narrow rows."""
    from variform.operators.norm import check_order

    own = df.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size(record_issues(header, require_evidence)).cast("long")), F.lit(0)).alias("errors"))
    parts = [own, *[x.agg(F.lit(0).cast("long").alias("records"), F.count("*").alias("errors")) for x in (check_order(df), duplicate_variants(df))]]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.sum("records").alias("records"), F.sum("errors").alias("errors"))
    shown = F.least("errors", F.lit(max_diagnostics).cast("long"))
    return total.select(F.lit(header.version).alias("version"), "records", "errors", shown.alias("shown"), (F.col("errors") > max_diagnostics).alias("truncated"))


def first_diagnostics(diagnostics: DataFrame, n: int = 100) -> DataFrame:
    """The first n diagnostics by row, code and field."""
    return diagnostics.orderBy("row_id", "code", "field").limit(n)


