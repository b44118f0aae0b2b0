"""Validation of VCF text: the header's rules on the driver, a line's rules in Arrow batches, and the order of lines and
repeated variants as DataFrame operations. Rules about spelling need the text; the typed rows of ``validate`` have lost it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.operators.ordered import sums_before
from variform.sources.header import FIXED

# Reserved definitions (Number, Type); of some from a version on.
RESERVED_INFO = {
    "AA": ("1", "String"), "AC": ("A", "Integer"), "AD": ("R", "Integer"), "ADF": ("R", "Integer"), "ADR": ("R", "Integer"), "AF": ("A", "Float"), "AN": ("1", "Integer"),
    "BQ": ("1", "Float"), "CIEND": ("2", "Integer"), "CIGAR": ("A", "String"), "CIPOS": ("2", "Integer"), "DB": ("0", "Flag"), "DP": ("1", "Integer"), "END": ("1", "Integer"),
    "H2": ("0", "Flag"), "H3": ("0", "Flag"), "IMPRECISE": ("0", "Flag"), "MQ": ("1", "Float"), "MQ0": ("1", "Integer"), "NOVEL": ("0", "Flag"), "NS": ("1", "Integer"),
    "SB": ("1", "Float"), "SOMATIC": ("0", "Flag"), "SVLEN": ("1", "Integer"), "SVTYPE": ("1", "String"), "VALIDATED": ("0", "Flag"), "1000G": ("0", "Flag"),
}
RESERVED_FORMAT = {
    "AD": ("R", "Integer"), "ADF": ("R", "Integer"), "ADR": ("R", "Integer"), "DP": ("1", "Integer"), "EC": ("A", "Integer"), "FT": ("1", "String"), "GL": ("G", "Float"),
    "GLE": ("G", "String"), "GP": ("G", "Float"), "GQ": ("1", "Integer"), "GT": ("1", "String"), "HQ": ("2", "Integer"), "MQ": ("1", "Integer"), "PL": ("G", "Integer"),
    "PP": ("G", "Integer"), "PQ": ("1", "Integer"), "PS": ("1", "Integer"),
}
RESERVED_FROM_4 = {"INFO": {"SVLEN": ("A", "Integer")}, "FORMAT": {"PSL": ("P", "String"), "PSO": ("P", "Integer"), "PSQ": ("P", "Integer")}}
SV_KINDS = {"DEL", "INS", "DUP", "INV", "CNV"}
CLAIMS = {"DEL": {"D", "J", "DJ"}, "DUP": {"D", "J", "DJ"}, "CNV": {"D", "."}, "INV": {"J", "DJ", "."}, "INS": {"J", "DJ", "."}, "[]": {"J", "."}}
NOT_NEGATIVE, A_SHARE = {"AC", "AN", "DP", "END", "MQ0", "NS"}, {"AF", "GP"}

_BASES = re.compile("[ACGTNacgtn]+")
_NAME = r"[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*|<[^<>,\s]+>"
_CHROM = re.compile(_NAME)
_ALT = re.compile(rf"\*|[ACGTNacgtn]+\.?|\.[ACGTNacgtn]+|<[^<>,\s]+>|(?:[ACGTNacgtn]+([\[\]])(?:{_NAME}):0*[1-9]\d*\1)|(?:([\[\]])(?:{_NAME}):0*[1-9]\d*\2[ACGTNacgtn]+)")
_INTEGER = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])")
_CIGAR = re.compile(r"(?:0*[1-9]\d*[MIDNSHP=X])+")
_VALUE = re.compile(r'(?:"(?:[^"\\]|\\.)*"?|[^,"])*(?:,|$)')
_ITEM = re.compile(r'([^=,]*)(?:(=)("(?:[^"\\]|\\.)*"[^,]*|\[[^\]]*\][^,]*|[^,]*))?(?:,|$)')
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"')
_GENOME = re.compile(r"[0-9A-Za-z_.-]+")
_URL = re.compile(r"<?(?:ftp|https?)://(?:[^/@]*@)?((?=[0-9A-Za-z.-]*(?:[A-Za-z]|\.))[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)(?::[^/]*)?(?:/.*)?>?")


# ---------------------------------------------------------------- header

@dataclass
class Schema:
    """What lines are held against."""

    minor: int = 3
    info: dict[str, tuple[str, str]] = field(default_factory=dict)
    format: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: dict[str, int | None] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)

    def reserved(self, kind: str) -> dict[str, tuple[str, str]]:
        own = RESERVED_INFO if kind == "INFO" else RESERVED_FORMAT
        return own | RESERVED_FROM_4[kind] if self.minor >= 4 else own


def key_pattern(minor: int, kind: str) -> re.Pattern:
    """IDs: '_' within from 4.3 on, %XX from 4.4 on; FORMAT keys, and INFO keys from 4.3 on, start with a letter or '_'."""
    lettered = kind == "FORMAT" or minor >= 3
    inner = "[0-9A-Za-z._]" if minor >= 3 or not lettered else "[0-9A-Za-z.]"
    part = f"(?:{inner}|%[0-9A-Fa-f]{{2}})" if minor >= 4 else inner
    pattern = (r"(?=[A-Za-z_])" if lettered else "") + f"_?{part}*" if lettered else f"{part}+"
    return re.compile(f"(?!$)(?:{pattern}{'|1000G' if kind == 'INFO' and minor >= 3 else ''})")


def header_problems(text: str) -> tuple[list[tuple[int, str, str]], Schema]:
    """(line, code, message) of a header's problems, in line order, and what it declares. Of the codes, header.reference is a
    warning, all others are errors."""
    found: list[tuple[int, str, str]] = []
    schema = Schema()
    if not text:
        return [(0, "header.missing", "no header"), (0, "header.reference", "no reference")], schema
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    else:
        found.append((len(lines), "header.newline", "the last line has no line feed"))
    version = re.fullmatch(r"##fileformat=VCFv4\.(\d)", lines[0].rstrip("\r"))
    if not lines[0].startswith("##fileformat="):
        found.append((1, "header.fileformat", "the first line must be ##fileformat"))
    elif not version or not 1 <= int(version[1]) <= 5:
        found.append((1, "header.version", "version must be VCFv4.1 to VCFv4.5"))
    schema.minor = int(version[1]) if version else 3
    columns_at, seen, reference = None, set(), False
    for n, line in enumerate(lines, 1):
        line = line.rstrip("\r")
        if "�" in line:
            found.append((n, "header.utf8", "not UTF-8"))
        if line.startswith("##"):
            if columns_at:
                found.append((n, "header.meta-after-columns", "meta line after #CHROM"))
            reference |= line.startswith("##reference=") and len(line) > 12
            found += [(n, code, text) for code, text in _meta(line[2:], schema, seen)]
        elif line.startswith("#CHROM"):
            if columns_at:
                found.append((n, "header.duplicate-columns", f"#CHROM also on line {columns_at}"))
            columns_at = n
            found += [(n, code, text) for code, text in _columns(line[1:].split("\t"), schema)]
        elif line.startswith("#"):
            found.append((n, "header.columns", "neither ## nor #CHROM"))
        elif line:
            found.append((n, "header.record-before-columns" if not columns_at else "header.columns", "a record"))
    if columns_at is None:
        found.append((len(lines), "header.missing-columns", "no #CHROM line"))
    if not reference:
        found.append((len(lines), "header.reference", "no reference"))
    return found, schema


def _columns(columns: list[str], schema: Schema) -> Iterator[tuple[str, str]]:
    if columns[:8] != FIXED:
        yield "header.fixed-columns", "wrong fixed columns"
    if len(columns) > 8 and columns[8] != "FORMAT":
        yield "header.format-column", "the ninth column must be FORMAT"
    if len(columns) == 9:
        yield "header.samples", "FORMAT without samples"
    schema.samples = columns[9:]
    if "" in schema.samples:
        yield "header.sample-name", "empty sample name"
    if len(set(schema.samples)) != len(schema.samples):
        yield "header.duplicate-sample", "duplicate sample name"


def _meta(line: str, schema: Schema, seen: set) -> Iterator[tuple[str, str]]:
    key, sign, value = line.partition("=")
    if not sign:
        yield "header.meta-syntax", "key=value expected"
    elif not key:
        yield "header.meta-key", "empty key"
    elif key in ("INFO", "FORMAT", "FILTER", "ALT", "contig", "META", "PEDIGREE", "SAMPLE"):
        yield from _structured(key, value, schema, seen)
    elif not value:
        yield "header.meta-value", f"{key} is empty"
    elif key in ("assembly", "pedigreeDB") and not _URL.fullmatch(value):
        yield "header.url", f"bad URL {value}"


def _structured(key: str, value: str, schema: Schema, seen: set) -> Iterator[tuple[str, str]]:
    if not (value.startswith("<") and value.endswith(">")):
        yield "header.map-syntax", f"{key} needs <...>"
        return
    items = [(m[1], m[2], m[3] or "") for m in _ITEM.finditer(value[1:-1]) if m[0]]
    names = [name for name, _, _ in items]
    if any(not name or not sign for name, sign, _ in items) or len(set(names)) != len(names):
        yield "header.map-field", f"{key} has an empty, valueless or repeated field"
        return
    raw = {name: v for name, _, v in items}
    plain = {name: v[1:-1] if _QUOTED.fullmatch(v) else v for name, v in raw.items()}
    rules: dict[str, Callable] = {"contig": _contig, "META": _meta_fields, "PEDIGREE": _pedigree, "SAMPLE": _sample}
    yield from rules.get(key, _definition)(key, names, raw, plain, schema, seen)


def _required(plain: dict, *names: str) -> Iterator[tuple[str, str]]:
    for name in names:
        if name not in plain:
            yield "header.required-field", f"{name} is missing"


def _definition(key: str, names: list[str], raw: dict, plain: dict, schema: Schema, seen: set) -> Iterator[tuple[str, str]]:
    """INFO, FORMAT, FILTER and ALT lines; the first problem of a line is reported, and a line with one defines nothing."""
    typed = key in ("INFO", "FORMAT")
    orders = [["ID", "Number", "Type", "Description"]] if typed else [["ID", "Description"]] + ([["ID"]] if schema.minor >= 4 else [])
    legacy = key == "ALT" and schema.minor <= 2 and names == ["ID", "Number", "Type", "Description"] and (plain["Number"], plain["Type"]) == ("1", "String")
    if missing := next(_required(plain, "ID"), None):
        yield missing
    elif not legacy and (names[:4] if typed else names) not in orders:
        yield ("header.alt-fields" if key == "ALT" else "header.field-order"), f"{key} has its fields in another order"
    elif "Description" in raw and not _QUOTED.fullmatch(raw["Description"]):
        yield "header.description", f"{key} needs its Description in quotes"
    elif key == "ALT" and not legacy and plain["ID"].split(":")[0] not in SV_KINDS | {"BND", "*", "NON_REF"}:
        yield "header.alt-id", f"bad ALT ID {plain['ID']}"
    elif key != "ALT" and (not plain["ID"] or re.search(r"[\s,;=<>]", plain["ID"]) or (typed and not re.fullmatch(r"[A-Za-z_][0-9A-Za-z_.%]*|1000G", plain["ID"]))):
        yield "header.id", f"bad ID {plain['ID']}"
    elif typed and (problem := next(_typing(key, plain, schema), None)):
        yield problem
    elif (key, plain["ID"]) in seen:
        yield "header.duplicate-definition", f"{key}/{plain['ID']} is repeated"
    else:
        seen.add((key, plain["ID"]))
        if typed:
            (schema.info if key == "INFO" else schema.format)[plain["ID"]] = (plain["Number"], plain["Type"])


def _typing(key: str, plain: dict, schema: Schema) -> Iterator[tuple[str, str]]:
    number, kind = plain["Number"], plain["Type"]
    letters = {"A", "R", "G", "."}
    if key == "FORMAT":
        letters |= ({"P"} if schema.minor >= 4 else set()) | ({"LA", "LR", "LG", "M"} if schema.minor >= 5 else set())
    if number not in letters and not number.isdigit():
        yield "header.number", f"bad Number {number}"
    if kind not in {"Integer", "Float", "Character", "String"} | ({"Flag"} if key == "INFO" else set()):
        yield "header.type", f"bad Type {kind}"
    if (number == "0") != (kind == "Flag"):
        yield "header.number-zero", "Number=0 belongs to flags alone"
    reserved = schema.reserved(key).get(plain["ID"])
    if reserved and reserved != (number, kind):
        yield "header.reserved-definition", f"{key}/{plain['ID']} is reserved as Number={reserved[0]}, Type={reserved[1]}"


def _contig(key: str, names: list[str], raw: dict, plain: dict, schema: Schema, seen: set) -> Iterator[tuple[str, str]]:
    if "ID" not in plain:
        yield from _required(plain, "ID")
    elif not _CHROM.fullmatch(plain["ID"]) or plain["ID"].startswith("<"):
        yield "header.id", f"bad contig {plain['ID']}"
    else:
        length = plain.get("length")
        sound = length is not None and length.isdigit() and int(length) > 0
        if length is not None and not sound:
            yield "header.contig-length", "length must be positive"
        # a repeated contig is the first one, with the first length there is
        if schema.lengths.get(plain["ID"]) is None:
            schema.lengths[plain["ID"]] = int(length) if sound else None


def _meta_fields(key: str, names: list[str], raw: dict, plain: dict, schema: Schema, seen: set) -> Iterator[tuple[str, str]]:
    if names != ["ID", "Number", "Type", "Values"]:
        yield "header.meta-fields", "META needs ID, Number, Type and Values, in this order"
        return
    if plain["Number"] != ".":
        yield "header.meta-number", "META needs Number=."
    if plain["Type"] != "String":
        yield "header.meta-type", "META needs Type=String"
    if not re.fullmatch(r"\[\s*[^\s,][^,]*(,\s*[^\s,][^,]*)*\]", plain["Values"]):
        yield "header.meta-values", "META needs a list in brackets"


def _pedigree(key: str, names: list[str], raw: dict, plain: dict, schema: Schema, seen: set) -> Iterator[tuple[str, str]]:
    if schema.minor >= 3 and "ID" not in plain:
        yield from _required(plain, "ID")
        return
    for name, value in plain.items():
        if not _GENOME.fullmatch(value):
            yield "header.pedigree-value", f"bad value of {name}"


def _sample(key: str, names: list[str], raw: dict, plain: dict, schema: Schema, seen: set) -> Iterator[tuple[str, str]]:
    if "ID" not in plain:
        yield from _required(plain, "ID")
        return
    if not _GENOME.fullmatch(plain["ID"]):
        yield "header.sample-id", f"bad SAMPLE ID {plain['ID']}"
    if schema.minor <= 2:
        yield from _required(plain, "Genomes", "Mixture", "Description")
        for name, value in raw.items():
            if name != "Description" and value.startswith('"'):
                yield "header.sample-value", f"{name} must not be quoted"


# ---------------------------------------------------------------- records

def split_values(text: str) -> list[str]:
    """Values between commas; commas in quotes do not count."""
    return text.split(",") if '"' not in text else [m[0].removesuffix(",") for m in _VALUE.finditer(text + ",") if m[0]]


def multisets(alleles: int, ploidy: int) -> int:
    return math.comb(alleles + ploidy - 1, ploidy)


def _number(text: str) -> float | None:
    if text == ".":
        return 0.0
    return float(text) if _FLOAT.fullmatch(text) else None


class LineRules:
    """The problems of a record's line by itself: (code, field) pairs, one for every value that breaks a rule."""

    def __init__(self, schema: Schema, require_evidence: bool = False):
        self.schema, self.require_evidence, self.minor = schema, require_evidence, schema.minor
        self.info = schema.reserved("INFO") | schema.info
        self.format = schema.reserved("FORMAT") | schema.format
        self.info_key, self.format_key = key_pattern(self.minor, "INFO"), key_pattern(self.minor, "FORMAT")

    def problems(self, line: str) -> Iterator[tuple[str, str | None]]:
        if "�" in line:
            yield "record.utf8", None
        columns = line.split("\t")
        expected = 8 + (1 + len(self.schema.samples) if self.schema.samples else 0)
        if len(columns) != expected:
            yield "record.columns", None
            return
        chrom, pos, ids, ref, alt, qual, filters, info = columns[:8]
        alts = [] if alt == "." else alt.split(",")
        if not _CHROM.fullmatch(chrom):
            yield "record.chrom", "CHROM"
        position = int(pos) if re.fullmatch(r"\+?\d{1,10}", pos) and int(pos) <= 2147483647 else None
        if position is None:
            yield "record.pos", "POS"
        yield from self._listed(ids, "ID", "record.id", "record.duplicate-id", lambda x: bool(x) and not re.search(r"\s", x))
        if not _BASES.fullmatch(ref):
            yield "record.ref", "REF"
        yield from self._alternates(alts)
        if qual != "." and not (_FLOAT.fullmatch(qual) and not float(qual) < 0):
            yield "record.qual", "QUAL"
        if filters != "PASS":
            yield from self._listed(filters, "FILTER", "record.filter", "record.duplicate-filter", lambda x: bool(x) and x not in (".", "0") and not re.search(r"\s", x))
        keys = yield from self._infos(info, len(alts), chrom, position)
        has_calls = False
        if self.schema.samples:
            has_calls = yield from self._samples(columns[8], columns[9:], len(alts))
        if self.require_evidence and not has_calls and "AF" not in keys and not {"AC", "AN"} <= keys:
            yield "record.evidence", None
        if self.minor >= 4:
            yield from StructuralRules(alts or ["."], info, columns[8:]).problems()

    @staticmethod
    def _listed(text: str, name: str, bad: str, repeated: str, sound: Callable[[str], bool]) -> Iterator[tuple[str, str]]:
        seen = set()
        for value in [] if text == "." else text.split(";"):
            if not sound(value):
                yield bad, name
                return
            if value in seen:
                yield repeated, name
            seen.add(value)

    def _alternates(self, alts: list[str]) -> Iterator[tuple[str, str]]:
        seen = set()
        for a in alts:
            if not _ALT.fullmatch(a):
                yield "record.alt", "ALT"
            elif self.minor < 4 or _BASES.fullmatch(a):
                # from 4.4 on, symbolic alleles may stand twice
                if a in seen:
                    yield "record.duplicate-alt", "ALT"
                seen.add(a)

    def _infos(self, text: str, n_alts: int, chrom: str, position: int | None) -> Iterator[tuple[str, str]]:
        keys: set[str] = set()
        if text == ".":
            # such a record's position is not held against the contig either
            return keys
        if not text:
            yield "record.info", "INFO"
            return keys
        length = self.schema.lengths.get(chrom)
        for item in text.split(";"):
            key, sign, raw = item.partition("=")
            if not self.info_key.fullmatch(key):
                yield "record.info-key", "INFO"
                continue
            if key in keys:
                yield "record.duplicate-info", "INFO"
                continue
            keys.add(key)
            if key in self.info:
                yield from self._value(key, raw if sign else None, self.info[key], n_alts, None, None)
            if key == "END" and raw.isdigit() and length is not None and int(raw) > length:
                yield "record.contig-bound", "INFO/END"
        if position is not None and length is not None and position > length + 1:
            yield "record.contig-bound", "POS"
        return keys

    def _samples(self, form: str, samples: list[str], n_alts: int) -> Iterator[tuple[str, str]]:
        if form in ("", "."):
            yield "record.format", "FORMAT"
            return False
        keys = form.split(":")
        for i, key in enumerate(keys):
            if not self.format_key.fullmatch(key) or key in keys[:i]:
                yield "record.format-key", "FORMAT"
        if "GT" in keys[1:] and keys[0] != "GT":
            yield "record.gt-order", "FORMAT/GT"
        for text in samples:
            if text == "." or (not text and self.minor >= 5):
                continue
            values = text.split(":")
            if not text:
                yield "record.sample", "sample"
            elif len(values) > len(keys):
                yield "record.sample-width", "sample"
            else:
                ploidy = (yield from self._call(values[0], n_alts)) if keys[0] == "GT" else 2
                given = dict(zip(keys, values, strict=False))
                local = (yield from self._local(given["LAA"], n_alts)) if "LAA" in given else None
                for key, raw in zip(keys, values, strict=False):
                    if key != "GT" and key in self.format:
                        yield from self._value(key, raw, self.format[key], n_alts, local, ploidy)
        return "GT" in keys

    def _call(self, text: str, n_alts: int) -> Iterator[tuple[str, str]]:
        if text == ".":
            return 1
        alleles = re.split(r"[/|]", re.sub(r"[/|]$", "", text[1:] if text[:1] in ("/", "|") else text) if self.minor >= 4 else text[1:] if text[:1] in ("/", "|") else text)
        if "" in alleles:
            yield "record.genotype", "FORMAT/GT"
        else:
            for a in alleles:
                if a != "." and not (re.fullmatch(r"\+?\d+", a) and int(a) <= n_alts):
                    yield "record.genotype-allele", "FORMAT/GT"
        return len(alleles)

    @staticmethod
    def _local(text: str, n_alts: int) -> Iterator[tuple[str, str]]:
        if text == ".":
            return None
        values, seen = text.split(",") if text else [], set()
        for v in values:
            if not (v.isdigit() and 1 <= int(v) <= n_alts) or int(v) in seen:
                yield "record.local-allele", "FORMAT/LAA"
            elif v.isdigit():
                seen.add(int(v))
        return len(values)

    def _value(self, key: str, raw: str | None, definition: tuple[str, str], n_alts: int, local: int | None, ploidy: int | None) -> Iterator[tuple[str, str]]:
        number, kind = definition
        if kind == "Flag":
            if raw not in (None, "0", "1"):
                yield "record.flag-value", key
            return
        if raw is None:
            yield "record.missing-value", key
            return
        if raw == ".":
            return
        if not raw and self.minor < 5 and number != "0":
            yield "record.empty-value", key
            return
        values = split_values(raw) if raw else []
        wanted = {
            "A": n_alts, "R": n_alts + 1, "G": None if ploidy is None else multisets(n_alts + 1, ploidy), "P": ploidy, "LA": local, "LR": None if local is None else local + 1,
            "LG": None if local is None or ploidy is None else multisets(local + 1, ploidy),
        }.get(number, int(number) if number.isdigit() else None)
        if wanted is not None and len(values) != wanted:
            yield "record.cardinality", key
        for v in values:
            if v == ".":
                continue
            whole = int(v) if _INTEGER.fullmatch(v) else None
            real = float(v) if _FLOAT.fullmatch(v) else None
            sound = {
                "Integer": whole is not None and -2147483640 <= whole <= 2147483647, "Float": real is not None, "Character": len(v) == 1,
            }.get(kind, not re.search(r"[ \t\n\f\r]", v))
            if not sound:
                yield "record.value-type", key
            if (key in NOT_NEGATIVE and whole is not None and whole < 0) or (key in A_SHARE and real is not None and not 0 <= real <= 1):
                yield "record.value-range", key
            if key == "CIGAR" and not _CIGAR.fullmatch(v):
                yield "record.cigar", key


class StructuralRules:
    """Rules from version 4.4 on: structural alleles, tandem repeats, confidence intervals, copy numbers and phase sets."""

    def __init__(self, alts: list[str], info: str, columns: list[str]):
        self.alts, self.columns = alts, columns
        self.info = {k: v.split(",") for k, sign, v in (item.partition("=") for item in info.split(";")) if sign}
        self.inner = [a[1:-1] if a.startswith("<") and a.endswith(">") else None for a in alts]
        self.kinds = [None if x is None else x.split(":")[0] for x in self.inner]

    def problems(self) -> Iterator[tuple[str, str | None]]:
        yield from self._structural()
        if repeats := self.inner.count("CNV:TR"):
            yield from self._repeats(repeats)
        yield from self._interval("INFO/CICN", self.info.get("CICN"), 2 * len(self.alts), "record.cicn-cardinality")
        if self.columns:
            yield from self._calls()

    def _structural(self) -> Iterator[tuple[str, str]]:
        for x, kind in zip(self.inner, self.kinds, strict=True):
            if x and ":" in x and kind not in SV_KINDS:
                yield "record.symbolic-alt", "ALT"
        if SV_KINDS & set(self.kinds) and "SVLEN" not in self.info:
            yield "record.svlen-required", "INFO/SVLEN"
        claims = self.info.get("SVCLAIM")
        if claims is None:
            if {"DEL", "DUP"} & set(self.kinds):
                yield "record.svclaim-required", "INFO/SVCLAIM"
        elif len(claims) != len(self.alts):
            yield "record.svclaim-cardinality", "INFO/SVCLAIM"
        else:
            for alt, kind, claim in zip(self.alts, self.kinds, claims, strict=True):
                broken = kind is None and re.search(r"[\[\]]", alt)
                if claim not in CLAIMS.get("[]" if broken else kind, {"."}):
                    yield "record.svclaim", "INFO/SVCLAIM"

    @staticmethod
    def _interval(name: str, values: list[str] | None, size: int | None, wrong: str) -> Iterator[tuple[str, str]]:
        """Pairs of bounds that must hold zero between them; size: how many values there must be, None for any pairs."""
        if values is None:
            return
        if len(values) != size if size is not None else len(values) % 2:
            yield wrong, name
            return
        for low, high in zip(values[::2], values[1::2], strict=True):
            a, b = _number(low), _number(high)
            if (a is not None and a > 0) or (b is not None and b < 0):
                yield "record.confidence-interval", name

    def _repeats(self, n: int) -> Iterator[tuple[str, str]]:
        info = self.info
        units, lengths = info.get("RUS"), info.get("RUL")
        if "RN" in info:
            n = sum(int(v) for v in info["RN"] if v.isdigit())
        if set(units or ".") <= {"."} and set(lengths or ".") <= {"."}:
            yield "record.repeat-unit-required", "INFO"
        if units and lengths:
            yield "record.repeat-unit-redundant", "INFO"
        for key in ("RUS", "RUL", "RUC", "RB"):
            if key in info and len(info[key]) != n:
                yield "record.repeat-cardinality", key
        for unit, length in zip(units or [], lengths or [], strict=False):
            if unit != "." and length.isdigit() and int(length) != len(unit):
                yield "record.repeat-unit-length", "INFO/RUL"
        for key, parent in (("CIRUC", "RUC"), ("CIRB", "RB")):
            if key not in info:
                continue
            if parent not in info:
                yield "record.repeat-interval-parent", key
            elif len(info[key]) != 2 * len(info[parent]):
                yield "record.repeat-interval-cardinality", key
            else:
                for i, value in enumerate(info[parent]):
                    if value == "." and info[key][2 * i : 2 * i + 2] != [".", "."]:
                        yield "record.repeat-interval-missing", key
                yield from self._interval(key, info[key], None, "record.repeat-interval-cardinality")
        sizes = lengths if lengths else [u if u == "." else str(len(u)) for u in units or []]
        for bases, count, size in zip(info.get("RB", []), info.get("RUC", []), sizes, strict=False):
            if "." not in (bases, count, size) and all(_FLOAT.fullmatch(x) for x in (bases, count, size)):
                if abs(float(bases) - float(count) * float(size)) > 0.05 * max(1.0, abs(float(bases))):
                    yield "record.repeat-bases", "INFO/RB"
        if "RUB" in info:
            counts = [v for v in info.get("RUC", []) if v != "."]
            if "RUC" not in info:
                yield "record.rub-parent", "INFO/RUB"
            else:
                if not all(v.isdigit() for v in counts):
                    yield "record.rub-ruc", "INFO/RUC"
                if len(info["RUB"]) != sum(int(v) for v in counts if v.isdigit()):
                    yield "record.rub-cardinality", "INFO/RUB"

    def _calls(self) -> Iterator[tuple[str, str]]:
        keys = self.columns[0].split(":")
        if "CICN" in keys and "CN" not in keys:
            yield "record.format-cicn-parent", "FORMAT/CICN"
        lengths = self.info.get("SVLEN", [])
        if "CN" in keys and len(lengths) == len(self.alts):
            if len({v for v, kind in zip(lengths, self.kinds, strict=True) if kind in ("DEL", "DUP", "CNV")}) > 1:
                yield "record.copy-number-svlen", "INFO/SVLEN"
        for text in self.columns[1:]:
            given = dict(zip(keys, text.split(":"), strict=False))
            if "CICN" in given:
                yield from self._interval("FORMAT/CICN", given["CICN"].split(","), None, "record.format-cicn-cardinality")
            if "PSL" in given:
                sets = given["PSL"].split(",")
                for phase, value in zip(separators(given["GT"]) if "GT" in given else [], sets, strict=False):
                    if phase == "/" and value != ".":
                        yield "record.psl-unphased", "FORMAT/PSL"
                for key in ("PSO", "PSQ"):
                    for name, value in zip(sets, given[key].split(",") if key in given else [], strict=False):
                        if name == "." and value != ".":
                            yield "record.phase-value", key


def separators(call: str) -> str:
    """The separator before each allele of a call; the first allele's is '|' unless one is written or a '/' stands within."""
    call = re.sub(r"[/|]$", "", call)
    written = "".join(c for c in call if c in "/|")
    return written if call[:1] in ("/", "|") else ("/" if "/" in call[1:] else "|") + written


def line_problems(lines: DataFrame, schema: Schema, require_evidence: bool = False) -> DataFrame:
    """(row_id, code, field) of every problem that a line (row_id, value) has by itself. From 4.4 on empty lines are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = LineRules(schema, require_evidence)
        for batch in batches:
            ids, codes, fields = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text and schema.minor >= 4:
                    continue
                for code, name in rules.problems(text):
                    ids.append(row)
                    codes.append(code)
                    fields.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.string()), pa.array(fields, pa.string())], names=["row_id", "code", "field"])

    return lines.select("row_id", "value").mapInArrow(run, "row_id long, code string, field string")


def cross_problems(lines: DataFrame) -> DataFrame:
    """(row_id, code, field) of lines out of order and of variants that an earlier line has, by narrow rows. Contigs count in
    the order of their first lines."""
    from variform.operators.norm import with_previous
    from variform.operators.validate import duplicate_variants

    c = F.split("value", "\t")
    rows = lines.where(F.size(c) >= 8).select(
        "row_id", F.regexp_extract(F.get(c, F.lit(0)), "^<?(.*?)>?$", 1).alias("chrom"), F.expr("try_cast(split(value, '\t')[1] AS int)").alias("pos"), F.get(c, F.lit(3)).alias("ref"),
        F.filter(F.split(F.get(c, F.lit(4)), ","), lambda a: a.rlike("^[ACGTNacgtn]+$")).alias("alts"),
    ).where("pos IS NOT NULL")
    # one row a contig
    first = rows.groupBy("chrom").agg(F.min("row_id").alias("contig_idx"))
    placed = rows.join(F.broadcast(first), "chrom")
    same = F.col("before.contig_idx") == F.col("contig_idx")
    # a contig's first line is its number: a later line that follows another contig makes it no block
    split = ~same & (F.col("row_id") > F.col("contig_idx"))
    problem = F.when(split, F.struct(F.lit("record.contig-order").alias("code"), F.lit("CHROM").alias("field"))).when(
        same & (F.col("before.pos") > F.col("pos")), F.struct(F.lit("record.position-order").alias("code"), F.lit("POS").alias("field"))
    )
    order = with_previous(placed).withColumn("p", problem).where("p IS NOT NULL").select("row_id", "p.code", "p.field")
    return order.unionByName(duplicate_variants(rows))


def numbered(lines: DataFrame, before: int) -> DataFrame:
    """lines (row_id, value) with line: the line's number, after ``before`` lines of the header. row_id counts within the
    partition of its upper bits."""
    placed = lines.withColumn("_chunk", F.shiftright("row_id", 33))
    sizes = placed.groupBy("_chunk").agg((F.max("row_id") - F.shiftleft(F.col("_chunk"), 33) + 1).alias("_n"))
    base = sums_before(sizes, "_chunk", "_n", "_base")
    return placed.join(F.broadcast(base), "_chunk").withColumn("line", F.col("_base") + F.expr("row_id - shiftleft(_chunk, 33)") + 1 + before).drop("_chunk", "_base")


def unended(spark: SparkSession, path: str) -> bool:
    """Whether a plain text's last line has no line feed."""
    from variform.sources.vcf import _first_file, _magic

    fs, p, size = _first_file(spark, path)
    if not size or _magic(spark, path, 2) == b"\x1f\x8b":
        return False
    stream = fs.open(p)
    try:
        stream.seek(size - 1)
        return stream.read() != 10
    finally:
        stream.close()


def validate_vcf(spark: SparkSession, path: str, max_diagnostics: int = 100, require_evidence: bool = False) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, report) of a VCF. diagnostics: row_id (null for the header), line (of the header), severity, code,
    field; report: one row of format, version, records, errors, warnings, diagnostics (the first max_diagnostics as
    severity, line, code and field) and truncated."""
    from variform.sources.vcf import read_header_text, read_lines

    text = read_header_text(spark, path)
    problems, schema = header_problems(text)
    lines = read_lines(spark, path)
    body = lines.where(~F.col("value").startswith("#")).withColumn("value", F.regexp_replace("value", "\r$", ""))
    of_header = spark.createDataFrame(
        [(None, n, "warning" if code == "header.reference" else "error", code, None) for n, code, _ in problems], "row_id long, line int, severity string, code string, field string"
    )
    of_lines = line_problems(body, schema, require_evidence).unionByName(cross_problems(body))
    if schema.minor < 5 and unended(spark, path):
        of_header = of_header.unionByName(spark.createDataFrame([(None, None, "error", "input.newline", None)], of_header.schema))
    found = of_header.unionByName(of_lines.select("row_id", F.lit(None).cast("int").alias("line"), F.lit("error").alias("severity"), "code", "field"))
    return found, file_report(found, body, schema, max_diagnostics)


def file_report(found: DataFrame, body: DataFrame, schema: Schema, max_diagnostics: int = 100) -> DataFrame:
    """One row over the diagnostics and the record lines."""
    wanted = F.col("value") != "" if schema.minor >= 4 else F.lit(True)
    counts = body.agg(F.count(F.when(wanted, 1)).alias("records"))
    tallies = found.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))
    shown = found.orderBy(F.col("row_id").asc_nulls_first(), "line", "code", "field").limit(max_diagnostics)
    listed = shown.agg(F.array_sort(F.collect_list(F.struct("row_id", "line", "severity", "code", "field"))).alias("diagnostics"))
    one = counts.withColumn("_", F.lit(1)).join(tallies.withColumn("_", F.lit(1)), "_").join(listed.withColumn("_", F.lit(1)), "_")  # one row each
    truncated = F.col("errors") + F.col("warnings") > max_diagnostics
    return one.select(F.lit("vcf").alias("format"), F.lit(f"4.{schema.minor}").alias("version"), "records", "errors", "warnings", "diagnostics", truncated.alias("truncated"))
