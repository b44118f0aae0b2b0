"""Projection formats: '%CHROM\\t%POS[\\t%SAMPLE=%GT]' -> one text column, and its header row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.functions import variant
from variform.operators.view import sample_indexes
from variform.sources.header import Field, VariantHeader

_FIXED = ("CHROM", "POS0", "POS", "END0", "END", "ID", "REF", "FIRST_ALT", "ALT", "QUAL", "FILTER", "TYPE", "LINE")
# IUPAC codes of two bases in alphabetical order.
IUPAC = {"AA": "A", "AC": "M", "AG": "R", "AT": "W", "CC": "C", "CG": "S", "CT": "Y", "GG": "G", "GT": "K", "TT": "T"}


class FormatError(ValueError):
    """A projection format that does not parse or bind."""


@dataclass
class Token:
    kind: str  # text, field, samples
    value: object
    index: int | None = None
    scope: str | None = None  # INFO, fixed or None


def tokenize(fmt: str, inside: bool = False) -> list[Token]:
    out: list[Token] = []
    at, text = 0, ""

    def flush() -> None:
        nonlocal text
        if text:
            out.append(Token("text", text))
        text = ""

    while at < len(fmt):
        c = fmt[at]
        if c == "\\" and at + 1 < len(fmt):
            text += {"n": "\n", "t": "\t", "r": "\r"}.get(fmt[at + 1], fmt[at + 1])
            at += 2
        elif c == "[":
            end = fmt.find("]", at)
            if inside or end < 0 or "[" in fmt[at + 1 : end]:
                raise FormatError("sample loops do not nest and must be closed")
            flush()
            out.append(Token("samples", tokenize(fmt[at + 1 : end], True)))
            at = end + 1
        elif c == "%":
            m = re.compile(r"%(INFO/|/)?([A-Za-z_][\w.]*)(\{(\d+)\})?(\()?").match(fmt, at)
            if not m:
                raise FormatError(f"field name expected at {at}")
            if m[5]:
                raise FormatError(f"functions are not supported: %{m[2]}()")
            flush()
            out.append(Token("field", m[2], int(m[4]) if m[4] else None, {"INFO/": "INFO", "/": "fixed"}.get(m[1])))
            at = m.end()
        else:
            text += c
            at += 1
    flush()
    return out


def number_text(c: Column, float_: bool) -> Column:
    """Integers as they are; floats with six significant digits, as %g prints them."""
    if not float_:
        return c.cast("string")
    # a spelling of at most six digits without an exponent is what six digits give
    plain = lambda t: (F.length(t) <= 7) & t.rlike(r"^-?[0-9]+\.[0-9]*[1-9]$")
    return variant.let(c, lambda v: variant.let(v.cast("string"), lambda t: F.when(plain(t), t).otherwise(variant.let(v.cast("double"), _six_digits))))


def _six_digits(x: Column) -> Column:
    exponent = F.floor(F.log10(F.abs(x)))
    # the exponent after rounding to six digits decides between the two notations
    rounded = variant.let(exponent, lambda e: F.when(F.abs(x) / F.pow(F.lit(10.0), e) >= 9.999995, e + 1).otherwise(e))

    def spelled(e: Column) -> Column:
        plain = F.lit(None).cast("string")
        for digits in range(10, -1, -1):
            plain = F.when(e == 5 - digits, F.format_string(f"%.{digits}f", x)).otherwise(plain)
        plain = variant.let(plain, lambda p: F.when(p.contains("."), F.regexp_replace(p, r"\.?0+$", "")).otherwise(p))
        sci = F.format_string("%.5e", x)
        sci = F.regexp_replace(F.regexp_replace(sci, r"\.?0+e", "e"), r"e([+-])(\d)$", "e$1" + "0$2")
        return F.when((e < -4) | (e > 5), sci).otherwise(plain)

    # whole numbers of up to six digits are spelled as they are
    whole = (F.abs(x) < 1000000) & (x == F.floor(x))
    return (
        F.when(x.isNull(), F.lit(None)).when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0")
        .when(whole, x.cast("long").cast("string")).otherwise(variant.let(rounded, spelled))
    )


def value_text(value: Column, f: Field, index: int | None = None, reuse: bool = False) -> Column:
    """Text of a typed value; '.' if there is none. reuse: a single value answers every index."""
    is_float = f.type == "Float"
    if f.type == "Flag":
        return F.when(value, "1").otherwise(".")
    if f.scalar:
        one = number_text(value, is_float)
        if index is not None and index > 0 and not reuse:
            one = F.lit(None).cast("string")
        return F.coalesce(one, F.lit("."))
    item = lambda x: F.coalesce(number_text(x, is_float), F.lit("."))
    if index is None:
        return F.coalesce(F.when(F.size(value) > 0, F.array_join(F.transform(value, item), ",")), F.lit("."))
    nth = F.get(value, F.lit(index))
    if reuse:
        nth = F.when(F.size(value) == 1, F.get(value, F.lit(0))).otherwise(nth)
    return F.coalesce(number_text(nth, is_float), F.lit("."))


def _allele_text(a: Column) -> Column:
    return F.coalesce(F.when(a == 0, F.col("ref")).otherwise(F.get("alts", a - 1)), F.lit("."))


def translated(gt: Column) -> Column:
    """A genotype in bases, separators kept."""
    body = F.zip_with(gt["alleles"], gt["phased"], lambda a, p: F.concat(F.when(F.coalesce(p, F.lit(False)), "|").otherwise("/"), _allele_text(a)))
    joined = F.array_join(body, "")
    return F.coalesce(F.when(F.size(gt["alleles"]) > 0, F.substring(joined, F.lit(2), F.length(joined))), F.lit("."))


def iupac(gt: Column) -> Column:
    """The IUPAC code of a diploid single-base call, else the translated genotype."""
    bases = F.array_sort(F.transform(gt["alleles"], lambda a: F.upper(_allele_text(a))))
    pair = F.array_join(bases, "")
    code = F.lit(None).cast("string")
    for k, v in IUPAC.items():
        code = F.when(pair == k, v).otherwise(code)
    return F.coalesce(F.when(F.size(gt["alleles"]) == 2, code), translated(gt))


class Projection:
    """A format bound to a header."""

    def __init__(self, fmt: str, header: VariantHeader, samples: list[str] | None = None, exclude: bool = False, newline: bool = True):
        self.header, self.tokens = header, tokenize(fmt)
        self.places = sample_indexes(header, samples, exclude) if samples is not None else list(range(len(header.samples)))
        has_newline = any("\n" in t.value for t in self.tokens if t.kind == "text")
        self.ends = newline and not has_newline
        self.info_end = F.col("info.END") if "END" in header.infos else None

    def site_field(self, t: Token) -> Column:
        name, h = t.value, self.header
        if t.scope == "INFO" or (t.scope is None and name not in (*_FIXED, "INFO", "FORMAT")):
            f = h.infos.get(name)
            if f is None:
                raise FormatError(f"INFO/{name} is not declared")
            return value_text(F.col("info")[name], f, t.index, reuse=True)
        joined = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(".")
        if name == "ALT" and t.index is not None:
            return F.coalesce(F.get("alts", F.lit(t.index)), F.lit("."))
        end = variant.end_pos(self.info_end)
        columns = {
            "CHROM": lambda: F.col("chrom"), "POS": lambda: F.col("pos").cast("string"), "POS0": lambda: (F.col("pos") - 1).cast("string"),
            "END": lambda: end.cast("string"), "END0": lambda: (end - 1).cast("string"), "ID": lambda: joined("ids", ";"), "REF": lambda: F.col("ref"),
            "ALT": lambda: joined("alts", ","), "FIRST_ALT": lambda: F.coalesce(F.get("alts", F.lit(0)), F.lit(".")),
            "QUAL": lambda: F.coalesce(number_text(F.col("qual"), True), F.lit(".")), "FILTER": lambda: joined("filters", ";"),
            "TYPE": lambda: variant.type_text(variant.record_class()), "INFO": self.info_text, "FORMAT": self.format_text, "LINE": self.line,
        }
        return columns[name]()

    def info_text(self) -> Column:
        if not self.header.infos:
            return F.lit(".")
        parts = []
        for k, f in self.header.infos.items():
            v = F.col("info")[k]
            parts.append(F.when(v, k) if f.type == "Flag" else F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), value_text(v, f))))
        text = F.array_join(F.array_compact(F.array(*parts)), ";")
        return F.when(text == "", ".").otherwise(text)

    def sample_text(self, s: Column) -> Column:
        return F.array_join(F.array(*[variant.gt_text(s[k]) if k == "GT" else value_text(s[k], f) for k, f in self.header.formats.items()]), ":")

    def format_text(self) -> Column:
        if not self.header.formats:
            return F.lit(".")
        return F.concat_ws("\t", F.lit(":".join(self.header.formats)), *[self.sample_text(F.get("samples", F.lit(i))) for i in self.places])

    def line(self) -> Column:
        fixed = [self.site_field(Token("field", n, scope="fixed")) for n in ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")]
        return F.concat_ws("\t", *fixed, *([self.format_text()] if self.header.samples else []))

    def sample_field(self, t: Token, s: Column, place: int) -> Column:
        name, formats = t.value, self.header.formats
        if t.scope is not None:
            return self.site_field(t)
        if name == "SAMPLE":
            return F.lit(self.header.samples[place])
        if name in ("GT", "TGT", "IUPACGT"):
            if "GT" not in formats:
                raise FormatError("FORMAT/GT is not declared")
            return {"GT": variant.gt_text, "TGT": translated, "IUPACGT": iupac}[name](s["GT"])
        if name in formats:  # inside the loop FORMAT shadows the fixed columns
            return value_text(s[name], formats[name], t.index)
        if name in _FIXED:
            return self.site_field(Token("field", name, t.index, "fixed"))
        raise FormatError(f"FORMAT/{name} is not declared")

    def column(self) -> Column:
        """The text of a record, without a final line feed of its own making."""
        parts: list[Column] = []
        for t in self.tokens:
            if t.kind == "text":
                parts.append(F.lit(t.value))
            elif t.kind == "field":
                parts.append(self.site_field(t))
            else:
                for place in self.places:
                    s = F.get("samples", F.lit(place))
                    parts += [F.lit(u.value) if u.kind == "text" else self.sample_field(u, s, place) for u in t.value]
        return F.concat(*parts) if parts else F.lit("")

    def header_row(self, indexed: bool = True) -> str:
        """'#[1]CHROM...' or, not indexed, '#CHROM...'; sample fields once per sample."""
        out, n = "#", 0

        def walk(tokens: list[Token], sample: str | None) -> None:
            nonlocal out, n
            for t in tokens:
                if t.kind == "text":
                    out += t.value
                elif t.kind == "samples":
                    for place in self.places:
                        walk(t.value, self.header.samples[place])
                else:
                    n += 1
                    label = "GT" if t.value in ("TGT", "IUPACGT") else t.value
                    out += (f"[{n}]" if indexed else "") + (f"{sample}:" if sample else "") + label

        walk(self.tokens, None)
        return out


def query(df: DataFrame, header: VariantHeader, fmt: str, samples: list[str] | None = None, exclude: bool = False) -> DataFrame:
    """(row_id, value): a record's projected text."""
    p = Projection(fmt, header, samples, exclude)
    value = p.column()
    # records are separate rows here, so a trailing line feed of the format is the row's end
    return df.select("row_id", F.regexp_replace(value, "\n$", "").alias("value"))
