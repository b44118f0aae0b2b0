"""Sizes of expressions, joins of intervals of all lengths, and what lies before a row, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from variform.functions import variant
from variform.functions.expression import Compiler, compile_truth, parse
from variform.operators import annotate, ordered, regions
from variform.operators.filtering import filter_variants
from variform.sources.derived import HEADER, variants

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("op", ["&", "|", "&&"])
def test_logic_grows_by_its_operands(spark, op):
    size = lambda n: len(compile_truth(f" {op} ".join(["FMT/DP > 3"] * n), HEADER).site._jc.toString())
    assert size(10) < 12 * size(1) + 2000


def test_nan_has_no_order(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 5.0, 0), (3, 6.0, 2)], "row_id long, qual float, dp int").withColumn("info", F.struct(F.col("dp").alias("DP")))
    held = {text: [r.row_id for r in df.where(compile_truth(text, HEADER).site).orderBy("row_id").collect()] for text in (
        "QUAL / INFO/DP > 2", "QUAL / INFO/DP < 2", "QUAL / INFO/DP = 3", "QUAL / INFO/DP != 3", "QUAL / INFO/DP >= 0", "MAX(QUAL / INFO/DP) > 2", "MIN(QUAL / INFO/DP) > 2")}
    # 0/0 is passed over by MAX and MIN, which leaves nothing to compare but their empty results
    assert list(held.values()) == [[2, 3], [], [3], [1, 2], [2, 3], [2, 3], [1, 2, 3]]


def test_intervals_of_all_lengths_meet(spark):
    r = random.Random(1)
    span = lambda: (a := r.randrange(1, 3_000_000), a + r.choice([0, 5, 127, 128, 5000, 9000, 600_000, 2_000_000]))
    t = [(i, r.choice("xy"), *span()) for i in range(150)]
    s = [(i, r.choice("xy"), *span()) for i in range(150)]
    for sources in (s, [x for x in s if x[3] - x[2] < 128]):
        got = annotate.overlap_join(spark.createDataFrame(t, "row_id long, chrom string, start int, end int"), spark.createDataFrame(sources, "serial long, chrom string, `from` int, `to` int"))
        want = [(a[0], b[0]) for a in t for b in sources if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2]]
        assert sorted((x.row_id, x.serial) for x in got.collect()) == sorted(want) and want


def test_long_lists_of_regions(spark):
    r = random.Random(2)
    places = [("x", a := r.randrange(1, 400_000), a + r.choice([0, 10, 40_000])) for _ in range(200)] + [("y", 50, regions.LAST), ("z", 5, 9)]
    rows = [(i, r.choice("xyzw"), a := r.randrange(1, 500_000), "A" * r.choice([1, 3, 30]), a + r.choice([0, 0, 70_000])) for i in range(400)] + [(900, "z", 9, "A", 9), (901, "z", 10, "A", 10), (902, "y", 1, "A" * 50, 50), (903, "y", 2_000_000_000, "A", 2_000_000_000)]
    df = spark.createDataFrame(rows, "row_id long, chrom string, pos int, ref string, fin int")
    merged = regions.merged(places)
    held = lambda c, a, b: any(c == m[0] and a <= m[2] and b >= m[1] for m in merged)
    got = regions._looked_up(df.select("row_id", "chrom", F.col("pos").alias("_start"), F.col("fin").alias("_end")), merged)
    assert {x.row_id: x._held for x in got.collect()} == {i: held(c, a, b) for i, c, a, _, b in rows}


def test_what_lies_before_a_row(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FOLD", 4)
    rows = [(k, k * 3 + 1) for k in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "chunk long, v long")
    sums = {r.chunk: r.s for r in ordered.sums_before(df, "chunk", "v", "s").collect()}
    assert sums == {k: sum(v for c, v in rows if c < k) for k, _ in rows}
    lasts = {r.chunk: r.l for r in ordered.last_before(df, "chunk", "v", "l").collect()}
    assert lasts == {k: next((v for c, v in reversed(rows) if c < k), None) for k, _ in rows}


def test_samples_are_bound_below_a_filter_only_where_they_are_made(spark, tmp_path):
    v = variants(spark, SF)
    v.write.parquet(str(tmp_path / "v"))
    read = spark.read.parquet(str(tmp_path / "v"))
    assert variant.bound(read, "samples") is read and variant.bound(v, "samples") is not v
    for df in (v, read):
        assert filter_variants(df, HEADER, include="FMT/DP > 30 & FMT/DP < 40")[0].count() == 820
    assert Compiler(HEADER).compile(parse("FMT/DP > 1")).passes is not None


def test_repeats_longer_than_the_window_meet_the_chunks(spark):
    from variform.operators import norm

    seq = "C" + "A" * 900 + "G" + "ACGT" * 300
    fasta = spark.createDataFrame([("1", k, seq[k * 1000 : k * 1000 + 1000]) for k in range(3)], "chrom string, chunk int, seq string")
    rows = [(1, "1", 898, "AA", ["A"]), (2, "1", 905, "G", ["T"]), (3, "1", 899, "A", ["AA"]), (4, "1", 50, "A", ["<DEL>"]), (5, "2", 50, "A", ["AA"])]
    df = spark.createDataFrame(rows, "row_id long, chrom string, pos int, ref string, alts array<string>")
    for window in (4, 256, 950):
        got = {r.row_id: (r.pos, r.ref, r.alts) for r in norm.normalize(df, fasta, 1000, window=window).collect()}
        assert got == {1: (1, "CA", ["C"]), 2: (905, "G", ["T"]), 3: (1, "C", ["CA"]), 4: (50, "A", ["<DEL>"]), 5: (50, "A", ["AA"])}
    ends = norm.with_reference(df, fasta, 1000, 5).select("row_id", "context", "context_start").collect()
    assert {r.row_id: r.context for r in ends if r.row_id != 5} == {i: seq[max(0, p - 6) : p - 1 + len(x) + 5] for i, c, p, x, _ in rows if c == "1"}
