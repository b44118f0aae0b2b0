"""Filter expressions: text -> tree -> Catalyst columns.

Values are site vectors (array columns, never null, null elements = missing) or sample matrices (one array per sample).
Truths are two-valued: no comparison can give NULL, so missing values never leak into a predicate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from variform.functions import stats, variant
from variform.sources.header import Field, VariantHeader


class ExpressionError(ValueError):
    """An expression that does not parse, bind or type."""


# ---------------------------------------------------------------- syntax

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w./]))|(?P<str>"(?:[^"\\]|\\.)*"(?:/i)?|'(?:[^'\\]|\\.)*'(?:/i)?)|(?P<file>@[^\s()\[\]&|=!<>,]+)
    |(?P<op>\|\||&&|==|!=|<=|>=|!~|[|&=<>~+\-*/%()\[\],:])|(?P<id>[^\s"'()\[\]&|=!<>~+\-*%,:@]+))""",
    re.X,
)
# binding strength of the infix operators: single-character logic binds tighter than its doubled form, | looser than &&
_STRENGTH = {"||": 1, "|": 2, "&&": 3, "&": 4, "=": 5, "!=": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "~": 5, "!~": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
_COMPARE = {"=", "!=", "<", "<=", ">", ">=", "~", "!~"}


@dataclass
class Node:
    kind: str  # num, str, file, name, call, neg, op
    value: object
    args: list = field(default_factory=list)
    subscript: str | None = None


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected character at {at}: {text[at:at + 10]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "id":
                # a name may hold a slash prefix (INFO/x); a division needs blanks or a number on its right
                m2 = re.match(r"(?i)(INFO|FMT|FORMAT)/[^\s\"'()\[\]&|=!<>~+\-*%,:@/]+", value)
                plain = m2[0] if m2 else value.split("/", 1)[0] if "/" in value else value
                self.tokens.append(("id", plain))
                at = m.start(kind) + len(plain)
                if at == m.start(kind):
                    self.tokens[-1] = ("op", "/")
                    at += 1
                continue
            self.tokens.append((kind, "=" if value == "==" else value))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None):
        token = self.peek()
        if value is not None and token[1] != value:
            raise ExpressionError(f"expected {value!r}, found {token[1]!r}")
        self.at += 1
        return token

    def parse(self) -> Node:
        node = self.infix(0)
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return node

    def infix(self, least: int) -> Node:
        left = self.prefix()
        while self.peek()[0] == "op" and (s := _STRENGTH.get(self.peek()[1], 0)) > least:
            op = self.take()[1]
            right = self.infix(s)
            if op in _COMPARE and self.peek()[1] in _COMPARE and self.peek()[0] == "op":
                raise ExpressionError("comparisons do not chain")
            left = Node("op", op, [left, right])
        return left

    def prefix(self) -> Node:
        kind, value = self.peek()
        if (kind, value) == ("op", "-"):
            self.take()
            return Node("neg", None, [self.prefix()])
        if (kind, value) == ("op", "("):
            self.take()
            inner = self.infix(0)
            self.take(")")
            return inner
        self.take()
        if kind == "num":
            return Node("num", float(value))
        if kind == "str":
            fold = value.endswith("/i")
            body = value[1 : -3 if fold else -1]
            return Node("str", (re.sub(r"\\([\"'\\])", r"\1", body), fold))
        if kind == "file":
            return Node("file", value[1:])
        if kind != "id":
            raise ExpressionError(f"unexpected {value!r}" if value else "unexpected end of expression")
        if value == ".":
            raise ExpressionError('the missing value is written "."')
        if self.peek() == ("op", "("):
            self.take()
            args = [self.infix(0)]
            while self.peek() == ("op", ","):
                self.take()
                args.append(self.infix(0))
            self.take(")")
            return Node("call", value, args)
        node = Node("name", value)
        if self.peek() == ("op", "["):
            self.take()
            parts = []
            while self.peek() != ("op", "]"):
                if self.peek()[0] == "end":
                    raise ExpressionError("']' is missing")
                parts.append(self.take()[1])
            self.take("]")
            node.subscript = "".join(parts)
        return node


def parse(text: str) -> Node:
    return _Parser(text).parse()


# ---------------------------------------------------------------- values

NUM, STR, GT, FILTER = "number", "text", "genotype", "filter"


@dataclass
class Site:
    """A vector of the record: array column, and whether the value is absent (then the array holds one null)."""

    arr: Column
    kind: str
    absent: Column = field(default_factory=lambda: F.lit(False))
    literal: object = None


@dataclass
class Matrix:
    """A vector of every sample, and which samples a subscript selected (None: all)."""

    arr: Column
    kind: str
    selected: list[bool] | None = None
    field: Field | None = None
    own_values: bool = False  # a value subscript was given


@dataclass
class Truth:
    """Whether the record passes, and which samples do (None for record-level truths)."""

    site: Column
    passes: Column | None = None
    selected: list[bool] | None = None


def _dbl(c: Column) -> Column:
    return c.cast("array<double>")


def _flags(selected: list[bool] | None, n: int) -> Column:
    return F.array(*[F.lit(x) for x in (selected or [True] * n)])


def compare_numbers(op: str, a: Column, b: Column) -> Column:
    """Two-valued comparison of nullable doubles; in single precision unless a side exceeds 2**24. NaN equals nothing and
    has no order (Spark would put it above all numbers)."""
    ops: dict[str, Callable] = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    test = ops[op]
    wide = (a > 16777216) | (b > 16777216)
    held = F.when(F.isnan(a) | F.isnan(b), op == "!=").when(wide, test(a, b)).otherwise(test(a.cast("float"), b.cast("float")))
    if op in ("=", "!="):
        one_missing = a.isNull() != b.isNull()
        return F.when(a.isNull() & b.isNull(), op == "=").when(one_missing, op == "!=").otherwise(held)
    return F.when(a.isNull() | b.isNull(), F.lit(False)).otherwise(held)


def compare_text(op: str, a: Column, b: Column) -> Column:
    return a.eqNullSafe(b) if op == "=" else ~a.eqNullSafe(b)


# Names of the genotype classes.
GT_CLASSES = {"het", "hom", "ref", "alt", "mis", "hap", "RR", "RA", "AR", "AA", "aa", "Aa", "aA", "R", "A"}


def genotype_class(name: str, alleles: Column) -> Column:
    """Whether a call (array of nullable indexes) belongs to a class."""
    n = F.size(alleles)
    complete = (n > 0) & ~F.exists(alleles, lambda a: a.isNull())
    first = F.get(alleles, F.lit(0))
    differ = F.exists(alleles, lambda a: a != first)
    has_alt, has_ref = F.exists(alleles, lambda a: a > 0), F.exists(alleles, lambda a: a == 0)
    tests = {
        "mis": (n == 0) | F.exists(alleles, lambda a: a.isNull()),
        "hap": complete & (n == 1), "het": complete & (n > 1) & differ, "hom": complete & (n > 1) & ~differ,
        "ref": complete & ~has_alt, "alt": complete & has_alt,
        "RR": complete & (n > 1) & ~has_alt, "RA": complete & (n > 1) & differ & has_ref, "AA": complete & (n > 1) & ~differ & has_alt,
        "Aa": complete & (n > 1) & differ & ~has_ref, "R": complete & (n == 1) & ~has_alt, "A": complete & (n == 1) & has_alt,
    }
    tests |= {"AR": tests["RA"], "aa": tests["AA"], "aA": tests["Aa"]}
    return F.coalesce(tests[name], F.lit(False))


# ---------------------------------------------------------------- binding and compilation

_FIXED = {"CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "TYPE"}
_CALCULATED = {"N_ALT", "N_SAMPLES", "ILEN", "N_MISSING", "F_MISSING", "AC", "AN", "AF", "MAC", "MAF"}
_REDUCE = {"MAX": "MAX", "MIN": "MIN", "AVG": "AVG", "MEAN": "AVG", "MEDIAN": "MEDIAN", "STDEV": "STDEV", "SUM": "SUM"}
_PER_SAMPLE = {f"{p}{k}": v for k, v in _REDUCE.items() for p in ("SMPL_", "S")}


class Compiler:
    """Compiles trees against a header over the columns of its rows."""

    def __init__(self, header: VariantHeader, files: Callable[[str], list[str]] | None = None):
        self.header = header
        self.n = len(header.samples)
        self.read = files or _read_values

    def truth(self, text: str) -> Truth:
        """The truth of an expression; anything else at top level is an error."""
        out = self.compile(parse(text))
        if not isinstance(out, Truth):
            raise ExpressionError("the expression is not a condition")
        return out

    def compile(self, node: Node):
        if node.kind == "num":
            return Site(F.array(F.lit(node.value)), NUM, literal=node.value)
        if node.kind == "str":
            text = node.value[0]
            return Site(F.array(F.lit(None).cast("string") if text == "." else F.lit(text)), STR, literal=node.value)
        if node.kind == "file":
            return ("file", self.read(node.value))
        if node.kind == "name":
            return self.name(node.value, node.subscript)
        if node.kind == "neg":
            return self.arithmetic("-", Site(F.array(F.lit(0.0)), NUM), self.compile(node.args[0]))
        if node.kind == "call":
            return self.call(node.value.upper(), node.args)
        if node.args[0].kind == "file":
            raise ExpressionError("a value file stands on the right")
        left, right = (self.compile(a) for a in node.args)
        op = node.value
        if op in ("&", "&&", "|", "||"):
            return self.logic(op, left, right)
        if op in _COMPARE:
            return self.compare(op, left, right)
        return self.arithmetic(op, left, right)

    # names

    def name(self, text: str, sub: str | None):
        m = re.match(r"(?i)(INFO|FMT|FORMAT)/(.+)$", text)
        if m:
            kind = "INFO" if m[1].upper() == "INFO" else "FORMAT"
            known = (self.header.infos if kind == "INFO" else self.header.formats).get(m[2])
            if known is None:
                raise ExpressionError(f"undefined field {text}")
            return self.info(known, sub) if kind == "INFO" else self.format(known, sub)
        if text.upper() in _FIXED:
            return self.sub_site(self.fixed(text.upper()), sub)
        info, fmt = self.header.infos.get(text), self.header.formats.get(text)
        if info and fmt:
            raise ExpressionError(f"{text} is both INFO and FORMAT: prefix it")
        if info or fmt:
            return self.info(info, sub) if info else self.format(fmt, sub)
        if text in _CALCULATED:
            return self.sub_site(self.calculated(text), sub)
        raise ExpressionError(f"undefined field {text}")

    def fixed(self, name: str) -> Site:
        if name == "POS":
            return Site(F.array(F.col("pos").cast("double")), NUM)
        if name == "QUAL":
            return Site(F.array(F.col("qual").cast("double")), NUM)
        if name in ("CHROM", "REF"):
            return Site(F.array(F.col(name.lower())), STR)
        if name == "TYPE":
            return Site(F.array(variant.type_text(variant.record_class())), STR)
        column = F.col({"ID": "ids", "ALT": "alts", "FILTER": "filters"}[name])
        return Site(F.when(F.size(column) > 0, column).otherwise(F.array(F.lit(None).cast("string"))), FILTER if name == "FILTER" else STR)

    def calculated(self, name: str) -> Site:
        missing = F.lit(None).cast("double")
        has_gt = "GT" in self.header.formats and self.n > 0
        if name == "N_ALT":
            return Site(F.array(F.size("alts").cast("double")), NUM)
        if name == "N_SAMPLES":
            return Site(F.array(F.lit(float(self.n))), NUM)
        if name == "ILEN":
            lengths = F.transform("alts", lambda a: F.when(~a.startswith("<"), (F.length(a) - F.length("ref")).cast("double")))
            return Site(F.when(F.size("alts") > 0, lengths).otherwise(F.array(missing)), NUM)
        if name in ("N_MISSING", "F_MISSING"):
            if self.n == 0:
                return Site(F.array(F.lit(0.0)), NUM)
            if not has_gt:
                return Site(F.array(missing), NUM)
            n = F.size(F.filter("samples", lambda s: s["GT"]["alleles"].isNull() | F.exists(s["GT"]["alleles"], lambda a: a.isNull()))).cast("double")
            return Site(F.array(n if name == "N_MISSING" else n / self.n), NUM)
        if not has_gt:
            return Site(F.array(F.lit(0.0) if name == "AN" else missing), NUM)
        if name == "AN":
            return Site(F.array(F.size(variant.called()).cast("double")), NUM)
        counts = variant.allele_counts(F.col("alts"), variant.called())

        def of(counts: Column) -> Column:
            total = F.aggregate(counts, F.lit(0), lambda acc, c: acc + c)
            if name in ("MAC", "MAF"):
                def minor(t: Column) -> Column:
                    least = F.array_min(F.filter(counts, lambda c: c > 0))
                    value = F.when(least == t, 0).otherwise(least).cast("double")
                    return F.array(F.when(t > 0, value if name == "MAC" else value / F.greatest(t, F.lit(1))))

                return variant.let(total, minor)

            def per_alt(t: Column) -> Column:
                alts = F.slice(counts, 2, F.greatest(F.size("alts"), F.lit(1)))
                values = alts.cast("array<double>") if name == "AC" else F.transform(alts, lambda c: c / F.greatest(t, F.lit(1)).cast("double"))
                return F.when(t == 0, F.array(missing)).when(F.size("alts") == 0, F.array(F.lit(0.0))).otherwise(values)

            return variant.let(total, per_alt)

        return Site(variant.let(counts, of), NUM)

    def info(self, f: Field, sub: str | None) -> Site:
        value = F.col("info")[f.id]
        if f.type == "Flag":
            return Site(F.array(F.when(F.coalesce(value, F.lit(False)), F.lit(1.0))), NUM, ~F.coalesce(value, F.lit(False)))
        kind = NUM if f.type in ("Integer", "Float") else STR
        to = "double" if kind == NUM else "string"
        arr = F.array(value.cast(to)) if f.scalar else F.coalesce(F.when(F.size(value) > 0, value.cast(f"array<{to}>")), F.array(F.lit(None).cast(to)))
        return self.sub_site(Site(arr, kind, value.isNull()), sub)

    def sub_site(self, v: Site, sub: str | None) -> Site:
        """[i], [i-j], [i-], [i,j], [*]: one index on a singleton gives it regardless, an index out of range is absent."""
        if sub is None or sub == "*":
            return v
        none = F.lit(None).cast("double" if v.kind == NUM else "string")
        if re.fullmatch(r"\d+", sub):
            picked = F.when(F.size(v.arr) == 1, F.get(v.arr, F.lit(0))).otherwise(F.get(v.arr, F.lit(int(sub))))
            return Site(F.array(picked), v.kind, v.absent | picked.isNull())
        wanted = self.index_test(sub)
        kept = F.filter(v.arr, lambda x, i: wanted(i))
        return Site(F.when(F.size(kept) > 0, kept).otherwise(F.array(none)), v.kind, v.absent | (F.size(kept) == 0))

    @staticmethod
    def index_test(sub: str) -> Callable[[Column], Column]:
        bounds = []
        for part in sub.split(","):
            m = re.fullmatch(r"(\d+)(-(\d*))?", part)
            if not m:
                raise ExpressionError(f"bad subscript [{sub}]")
            bounds.append((int(m[1]), int(m[1]) if m[2] is None else int(m[3]) if m[3] else None))

        def test(i: Column) -> Column:
            out = F.lit(False)
            for lo, hi in bounds:
                out = out | ((i >= lo) & (F.lit(True) if hi is None else i <= hi))
            return out

        return test

    def format(self, f: Field, sub: str | None) -> Matrix:
        selected, values = None, None
        if sub is not None:
            sample_part, _, value_part = sub.partition(":")
            if sample_part == "GT" and not value_part:
                sample_part, value_part = "", "GT"
            if sample_part.startswith("@"):
                wanted = set(self.read(sample_part[1:]))
                selected = [s in wanted for s in self.header.samples]
            elif sample_part not in ("", "*"):
                test = self._index_set(sample_part, self.n)
                if max(test) >= self.n:
                    raise ExpressionError(f"sample index {max(test)} of {self.n} samples")
                selected = [i in test for i in range(self.n)]
            values = value_part or None
        if f.id == "GT":
            return Matrix(F.transform("samples", lambda s: F.coalesce(s["GT"]["alleles"], F.array().cast("array<int>"))), GT, selected, f)
        kind = NUM if f.type in ("Integer", "Float") else STR
        to = "double" if kind == NUM else "string"
        none = F.lit(None).cast(to)

        def vector(s: Column) -> Column:
            v = s[f.id]
            arr = F.array(v.cast(to)) if f.scalar else F.coalesce(F.when(F.size(v) > 0, v.cast(f"array<{to}>")), F.array(none))
            if values in (None, "*"):
                return arr
            if values == "GT":
                called = F.array_sort(F.array_distinct(F.filter(F.coalesce(s["GT"]["alleles"], F.array().cast("array<int>")), lambda a: a.isNotNull())))
                return F.when(F.size(called) > 0, F.transform(called, lambda a: F.get(arr, a))).otherwise(F.array(none))
            if re.fullmatch(r"\d+", values):
                return F.array(F.get(arr, F.lit(int(values))))
            wanted = self.index_test(values)
            kept = F.filter(arr, lambda x, i: wanted(i))
            return F.when(F.size(kept) > 0, kept).otherwise(F.array(none))

        return Matrix(F.transform("samples", vector), kind, selected, f, values not in (None, "*", "GT"))

    @staticmethod
    def _index_set(text: str, n: int) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            m = re.fullmatch(r"(\d+)(-(\d*))?", part)
            if not m:
                raise ExpressionError(f"bad subscript [{text}]")
            out |= set(range(int(m[1]), (int(m[1]) if m[2] is None else int(m[3]) if m[3] else n - 1) + 1))
        return out

    # comparison

    def compare(self, op: str, a, b) -> Truth:
        if isinstance(a, Truth) or isinstance(b, Truth):
            raise ExpressionError("a condition cannot be compared")
        if isinstance(b, tuple):
            return self.value_set(op, a, b[1])
        for x, y, flip in ((a, b, op), (b, a, op)):
            if isinstance(x, Matrix) and x.kind == GT:
                if not (isinstance(y, Site) and y.kind == STR and isinstance(y.literal, tuple)):
                    raise ExpressionError("GT is compared with a quoted class, spelling or pattern")
                return self.genotype(flip, x, y.literal)
        if op in ("~", "!~"):
            if not (isinstance(b, Site) and isinstance(b.literal, tuple)):
                raise ExpressionError("a pattern must be quoted")
            if a.kind == NUM:
                raise ExpressionError("a pattern cannot match numbers")
            pattern = ("(?i)" if b.literal[1] else "") + b.literal[0]
            match = lambda x: F.coalesce(x, F.lit(".")).rlike(pattern)
            test = match if op == "~" else (lambda x: ~match(x))
            return self.any_of(a, test)
        kinds = {a.kind, b.kind}
        missing = [isinstance(v, Site) and isinstance(v.literal, tuple) and v.literal[0] == "." for v in (a, b)]
        if FILTER in kinds:
            if any(missing) and op in ("=", "!="):
                # a FILTER never equals the missing value
                return Truth(F.lit(op == "!="))
            raise ExpressionError("FILTER is matched with ~ only")
        if kinds == {NUM, STR}:
            if not any(missing):
                raise ExpressionError("text cannot be compared with a number")
            if missing[0]:
                a = Site(F.array(F.lit(None).cast("double")), NUM)
            else:
                b = Site(F.array(F.lit(None).cast("double")), NUM)
            kinds = {NUM}
        if kinds == {STR} and op not in ("=", "!="):
            raise ExpressionError("text is compared with = and != only")
        test = (lambda x, y: compare_numbers(op, x, y)) if kinds == {NUM} else (lambda x, y: compare_text(op, x, y))
        if isinstance(a, Site) and isinstance(b, Site):
            if b.literal is not None:
                return Truth(F.exists(a.arr, lambda x: test(x, F.get(b.arr, F.lit(0)))))
            return Truth(variant.let(b.arr, lambda right: F.exists(a.arr, lambda x: F.exists(right, lambda y: test(x, y)))))
        if isinstance(a, Matrix) and isinstance(b, Matrix):
            positional = F.zip_with(a.arr, b.arr, lambda u, v: F.exists(F.zip_with(u, v, test), lambda t: t))
            return self.sampled(positional, _merge(a.selected, b.selected))
        m, s, turned = (a, b, test) if isinstance(a, Matrix) else (b, a, lambda x, y: test(y, x))
        if s.literal is not None:
            return self.sampled(F.transform(m.arr, lambda vec: F.exists(vec, lambda x: turned(x, F.get(s.arr, F.lit(0))))), m.selected)
        passes = variant.let(s.arr, lambda right: F.transform(m.arr, lambda vec: F.exists(vec, lambda x: F.exists(right, lambda y: turned(x, y)))))
        return self.sampled(passes, m.selected)

    def any_of(self, a, test: Callable[[Column], Column]) -> Truth:
        if isinstance(a, Site):
            return Truth(F.exists(a.arr, test))
        return self.sampled(F.transform(a.arr, lambda vec: F.exists(vec, test)), a.selected)

    def value_set(self, op: str, a, values: list[str]) -> Truth:
        if op not in ("=", "!="):
            raise ExpressionError("a value file is compared with = or !=")
        if a.kind != STR:
            raise ExpressionError("a value file holds text")
        held = self.any_of(a, lambda x: F.coalesce(x, F.lit(".")).isin(*values) if values else F.lit(False))
        if op == "=":
            return held
        if held.passes is None:
            return Truth(~held.site)
        return self.sampled(F.transform(held.passes, lambda p: ~p), held.selected)

    def genotype(self, op: str, gt: Matrix, literal: tuple[str, bool]) -> Truth:
        text, fold = literal
        spelled = lambda s: variant.gt_text(s["GT"])
        if op in ("~", "!~"):
            match = lambda s: spelled(s).rlike(("(?i)" if fold else "") + text)
            passes = F.transform("samples", match if op == "~" else lambda s: ~match(s))
            return self.sampled(passes, gt.selected)
        if op not in ("=", "!="):
            raise ExpressionError("GT is compared with = and != only")
        if text in GT_CLASSES:
            test = lambda s: genotype_class(text, F.coalesce(s["GT"]["alleles"], F.array().cast("array<int>")))
        elif text == ".":
            test = lambda s: F.coalesce(F.size(s["GT"]["alleles"]), F.lit(0)) <= 0
        else:
            test = lambda s: spelled(s) == text
        return self.sampled(F.transform("samples", test if op == "=" else lambda s: ~test(s)), gt.selected)

    def sampled(self, passes: Column, selected: list[bool] | None) -> Truth:
        """A sample truth: unselected samples never pass, the record does if any sample does."""
        if selected is not None:
            passes = F.zip_with(passes, _flags(selected, self.n), lambda p, s: p & s)
        return Truth(F.exists(passes, lambda p: p), passes, selected)

    # logic

    def logic(self, op: str, a, b) -> Truth:
        if not (isinstance(a, Truth) and isinstance(b, Truth)):
            raise ExpressionError(f"{op} joins conditions")
        both = op[0] == "&"
        if a.passes is None and b.passes is None:
            return Truth(a.site & b.site if both else a.site | b.site)
        selected = _merge(a.selected, b.selected) if a.passes is not None and b.passes is not None else (a if a.passes is not None else b).selected
        if op == "&" and a.passes is not None and b.passes is not None:
            # samples pass only where their side does, so the record follows from them and nothing is mentioned twice
            passes = F.zip_with(a.passes, b.passes, lambda x, y: x & y)
            return Truth(F.exists(passes, lambda p: p), passes, selected)
        site = (a.site & b.site) if both else (a.site | b.site)
        chosen, nothing = _flags(selected, self.n), _flags([False] * self.n, self.n)
        if a.passes is None or b.passes is None:
            scalar, own = (a, b.passes) if a.passes is None else (b, a.passes)
            if op == "||":
                passes = F.when(scalar.site, chosen).otherwise(own)
            else:
                # with |, samples pass by their own side alone
                passes = F.when(scalar.site, own).otherwise(nothing) if both else own
        elif op == "||":
            passes = F.when(site, chosen).otherwise(nothing)
        else:
            passes = F.zip_with(a.passes, b.passes, lambda x, y: x | y)
            passes = F.when(site, passes).otherwise(nothing) if op == "&&" else passes
        return Truth(site, passes, selected)

    # arithmetic

    def arithmetic(self, op: str, a, b):
        for v in (a, b):
            if not isinstance(v, Site | Matrix) or v.kind != NUM:
                raise ExpressionError(f"{op} needs numbers")

        def apply(x: Column, y: Column) -> Column:
            if op == "+":
                return x + y
            if op == "-":
                return x - y
            if op == "*":
                return x * y
            if op == "%":
                whole = y.cast("long")
                return F.when(x.isNull() | y.isNull(), F.lit(None)).when(whole == 0, F.raise_error(F.lit("remainder of a division by zero"))).otherwise((x.cast("long") % F.when(whole != 0, whole)).cast("double"))
            inf = F.lit(float("inf"))
            by_zero = F.when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(float("nan")))
            return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))

        def vectors(u: Column, v: Column) -> Column:
            wide = F.zip_with(u, v, apply)
            alone_u = F.transform(v, lambda y: apply(F.get(u, F.lit(0)), y))
            alone_v = F.transform(u, lambda x: apply(x, F.get(v, F.lit(0))))
            unequal = F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")
            return F.when(F.size(u) == F.size(v), wide).when(F.size(u) == 1, alone_u).when(F.size(v) == 1, alone_v).otherwise(unequal)

        if isinstance(a, Site) and isinstance(b, Site):
            both = F.struct(a.arr.alias("a"), b.arr.alias("b"))
            return Site(variant.let(both, lambda x: vectors(x["a"], x["b"])), NUM, a.absent | b.absent)
        if isinstance(a, Matrix) and isinstance(b, Matrix):
            return Matrix(F.zip_with(a.arr, b.arr, vectors), NUM, _merge(a.selected, b.selected))
        m, s = (a, b) if isinstance(a, Matrix) else (b, a)
        one = F.when(F.size(s.arr) == 1, F.get(s.arr, F.lit(0))).otherwise(F.raise_error(F.lit("a sample value needs a single site value")).cast("double"))
        turned = apply if m is a else (lambda x, y: apply(y, x))
        return Matrix(F.transform(m.arr, lambda vec: F.transform(vec, lambda x: turned(x, one))), NUM, m.selected)

    # functions

    def call(self, name: str, nodes: list[Node]):
        args = [self.compile(n) for n in nodes]
        if name in ("N_PASS", "F_PASS"):
            t = self.one(name, args)
            if not isinstance(t, Truth) or t.passes is None:
                raise ExpressionError(f"{name} needs a condition on samples")
            n = F.size(F.filter(t.passes, lambda p: p)).cast("double")
            return Site(F.array(n if name == "N_PASS" else n / max(1, sum(t.selected or [True] * self.n))), NUM)
        if name in ("COUNT", "SMPL_COUNT", "SCOUNT"):
            return self.count(name, self.one(name, args))
        if name == "STRLEN":
            return self.mapped(self.one(name, args, STR, FILTER), self.strlen)
        if name == "ABS":
            return self.mapped(self.one(name, args, NUM), F.abs)
        if name == "PHRED":
            return self.mapped(self.one(name, args, NUM), lambda x: F.when(x > 0, F.lit(-4.34294481903) * F.log(x)).when(x == 0, F.lit(float("inf"))))
        if name == "BINOM":
            return stats.compile_binom(self, args)
        if name == "FISHER":
            return stats.compile_fisher(self, args)
        if name in _REDUCE:
            v = self.one(name, args, NUM)
            if isinstance(v, Matrix):
                flat = F.flatten(F.filter(F.zip_with(v.arr, _flags(v.selected, self.n), lambda x, s: F.when(s, x)), lambda x: x.isNotNull()))
                return self.reduced(_REDUCE[name], flat)
            return self.reduced(_REDUCE[name], v.arr)
        if name in _PER_SAMPLE:
            v = self.one(name, args, NUM)
            if isinstance(v, Site):
                return self.reduced(_PER_SAMPLE[name], v.arr)
            return Matrix(F.transform(v.arr, lambda vec: F.array(reduce_values(_PER_SAMPLE[name], vec))), NUM, v.selected)
        raise ExpressionError(f"unknown function {name}")

    @staticmethod
    def one(name: str, args: list, *kinds: str):
        if len(args) != 1:
            raise ExpressionError(f"{name} takes one argument")
        if kinds and (not isinstance(args[0], Site | Matrix) or args[0].kind not in kinds):
            raise ExpressionError(f"{name} cannot take this argument")
        return args[0]

    def reduced(self, how: str, arr: Column) -> Site:
        value = reduce_values(how, arr)
        return Site(F.array(value), NUM, value.isNull())

    @staticmethod
    def strlen(v):
        if isinstance(v, Site) and v.kind == FILTER:
            return Site(F.array(F.octet_length(F.array_join(v.arr, ";")).cast("double")), NUM)
        return lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("double")

    def mapped(self, v, f):
        if f == self.strlen:
            f = self.strlen(v)
            if isinstance(f, Site):
                return f
        if isinstance(v, Site):
            # an absent value stays absent
            return Site(F.transform(v.arr, lambda x: F.when(~v.absent, f(x))), NUM, v.absent)
        return Matrix(F.transform(v.arr, lambda vec: F.transform(vec, f)), NUM, v.selected)

    def count(self, name: str, v):
        if isinstance(v, Truth):
            n = v.site.cast("double") if v.passes is None else F.size(F.filter(v.passes, lambda p: p)).cast("double")
            return Site(F.array(n), NUM)
        present = lambda vec: F.size(F.filter(vec, lambda x: x.isNotNull())).cast("double")
        if isinstance(v, Site):
            return Site(F.array(F.when(v.absent, 0.0).otherwise(F.size(v.arr).cast("double"))), NUM)
        per_sample = F.transform(v.arr, present)
        if name != "COUNT":
            return Matrix(F.transform(per_sample, lambda n: F.array(n)), NUM, v.selected)
        kept = F.zip_with(per_sample, _flags(v.selected, self.n), lambda n, s: F.when(s, n).otherwise(0.0))
        return Site(F.array(F.aggregate(kept, F.lit(0.0), lambda acc, n: acc + n)), NUM)


def reduce_values(how: str, arr: Column) -> Column:
    """MAX, MIN, AVG, MEDIAN, STDEV (population) or SUM of the values there are; null if none."""

    def of(values: Column) -> Column:
        n = F.size(values)
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        if how in ("MAX", "MIN"):
            # NaN is passed over; without any other value the result is the empty one's, an infinity
            pick, empty = (F.array_max, float("-inf")) if how == "MAX" else (F.array_min, float("inf"))
            return F.coalesce(pick(F.filter(values, lambda x: ~F.isnan(x))), F.lit(empty))
        if how == "SUM":
            return total
        if how == "AVG":
            return total / n
        if how == "MEDIAN":
            half = F.floor(n / 2).cast("int")
            return variant.let(F.array_sort(values), lambda s: F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2))
        return variant.let(total / n, lambda mean: F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n))

    return variant.let(F.filter(arr, lambda x: x.isNotNull()), lambda values: F.when(F.size(values) > 0, of(values)))


def _merge(a: list[bool] | None, b: list[bool] | None) -> list[bool] | None:
    if a is None or b is None:
        return None
    return [x or y for x, y in zip(a, b, strict=True)]


def _read_values(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [line.split()[0] for line in f if line.split()]


def compile_truth(text: str, header: VariantHeader, files: Callable[[str], list[str]] | None = None) -> Truth:
    """The truth columns of an expression over the rows of a header."""
    return Compiler(header, files).truth(text)
