"""Binomial and Fisher tests: the only expression functions that need Arrow UDFs (no lgamma among the built-ins)."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_LIMIT = 2147483647
_DOUBLES = T.ArrayType(T.DoubleType())


def _checked(*counts: float) -> list[float]:
    for c in counts:
        if not (math.isfinite(c) and 0 <= c <= _LIMIT):
            raise ValueError(f"count out of range: {c}")
    return list(counts)


@lru_cache(maxsize=1 << 16)
def binom_p(a: float | None, b: float | None) -> float | None:
    """Two-sided binomial test of a against b at one half; null for 0, 0."""
    if a is None or b is None or math.isnan(a) or math.isnan(b):
        return None
    a, b = _checked(a, b)
    if a == b:
        return None if a == 0 else 1.0
    n, k = int(a + b), int(min(a, b))
    if n <= 2000:
        return min(1.0, 2.0 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    # the tail's terms, from its largest on, relative to it
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-18:
            break
    log_top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2.0 * math.exp(log_top) * total)


def fisher_p(a: float | None, b: float | None, c: float | None, d: float | None) -> float | None:
    """Two-sided Fisher exact test of [[a, b], [c, d]]."""
    values = (a, b, c, d)
    if any(v is None or math.isnan(v) for v in values):
        return None
    a, b, c, d = (int(v) for v in _checked(*values))
    row, col, n = a + b, a + c, a + b + c + d
    if n == 0:
        return None
    lg = math.lgamma
    fixed = lg(row + 1) + lg(n - row + 1) + lg(col + 1) + lg(n - col + 1) - lg(n + 1)
    log_p = lambda x: fixed - lg(x + 1) - lg(row - x + 1) - lg(col - x + 1) - lg(n - row - col + x + 1)
    own = log_p(a)
    low, high = max(0, row + col - n), min(row, col)
    return min(1.0, sum(math.exp(p) for x in range(low, high + 1) if (p := log_p(x)) <= own + 1e-7))


@pandas_udf(_DOUBLES)
def binom_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [binom_p(u, v) for u, v in zip(x, y, strict=True)] for x, y in zip(a, b, strict=True)])


@pandas_udf(_DOUBLES)
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    rows = zip(a, b, c, d, strict=True)
    return pd.Series([None if any(x is None for x in r) else [fisher_p(*v) for v in zip(*r, strict=True)] for r in rows])


def _scalar(v) -> object:
    return F.transform(v.arr, lambda vec: F.get(vec, F.lit(0)))


def _indexed(compiler, v, which: int):
    """Per sample, the value of the called allele ``which`` of a diploid call."""
    called = F.transform("samples", lambda s: s["GT"]["alleles"])
    return F.zip_with(v.arr, called, lambda vec, g: F.when(F.size(g) == 2, F.get(vec, F.get(g, F.lit(which)))))


def compile_binom(compiler, args):
    """BINOM(x): the two called alleles of a diploid call; BINOM(a, b)."""
    from variform.functions.expression import NUM, ExpressionError, Matrix, Site

    if len(args) == 1 and isinstance(args[0], Matrix) and args[0].kind == NUM:
        out = binom_udf(_indexed(compiler, args[0], 0), _indexed(compiler, args[0], 1))
        return Matrix(F.transform(out, lambda x: F.array(x)), NUM, args[0].selected)
    if len(args) == 1 and isinstance(args[0], Site):
        v = args[0]
        return Site(binom_udf(F.array(F.get(v.arr, F.lit(0))), F.array(F.get(v.arr, F.lit(1)))), NUM)
    if len(args) == 2 and all(getattr(v, "kind", None) == NUM for v in args):
        a, b = args
        if isinstance(a, Matrix) and isinstance(b, Matrix):
            return Matrix(F.transform(binom_udf(_scalar(a), _scalar(b)), lambda x: F.array(x)), NUM, a.selected)
        if isinstance(a, Site) and isinstance(b, Site):
            return Site(binom_udf(F.array(F.get(a.arr, F.lit(0))), F.array(F.get(b.arr, F.lit(0)))), NUM)
    raise ExpressionError("BINOM takes one field or two counts")


def compile_fisher(compiler, args):
    """FISHER(x) of four values, or FISHER(a, b) of two pairs (allele-indexed by GT for Number=R sample fields)."""
    from variform.functions.expression import NUM, ExpressionError, Matrix, Site

    if not all(getattr(v, "kind", None) == NUM for v in args):
        raise ExpressionError("FISHER needs numbers")
    if len(args) == 1 and isinstance(args[0], Site):
        v = args[0].arr
        return Site(fisher_udf(*[F.array(F.get(v, F.lit(i))) for i in range(4)]), NUM)
    if len(args) == 1:
        v = args[0].arr
        cells = [F.transform(v, _nth(i)) for i in range(4)]
        return Matrix(F.transform(fisher_udf(*cells), lambda x: F.array(x)), NUM, args[0].selected)
    if len(args) == 2 and all(isinstance(v, Site) for v in args):
        a, b = args
        return Site(fisher_udf(*[F.array(F.get(v.arr, F.lit(i))) for v in (a, b) for i in (0, 1)]), NUM)
    if len(args) == 2 and all(isinstance(v, Matrix) for v in args):
        cells = [F.transform(v.arr, _nth(i)) if v.own_values else _indexed(compiler, v, i) for v in args for i in (0, 1)]
        return Matrix(F.transform(fisher_udf(*cells), lambda x: F.array(x)), NUM, args[0].selected)
    raise ExpressionError("FISHER takes one field of four values or two of two")


def _nth(i: int):
    return lambda vec: F.get(vec, F.lit(i))
