"""Lines read in Arrow batches, against the expressions that read whatever is not spelled plainly."""

import math
import random

import pytest
from pyspark.sql import functions as F

from variform.functions.projection import number_text
from variform.sources import vcf
from variform.sources.header import VariantHeader

HEADER = VariantHeader.parse("""##fileformat=VCFv4.3
##INFO=<ID=DP,Number=1,Type=Integer,Description="">
##INFO=<ID=AF,Number=A,Type=Float,Description="">
##INFO=<ID=DB,Number=0,Type=Flag,Description="">
##INFO=<ID=NOTE,Number=.,Type=String,Description="">
##FORMAT=<ID=GT,Number=1,Type=String,Description="">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="">
##FORMAT=<ID=FT,Number=1,Type=String,Description="">
##contig=<ID=chr1,length=1000000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb""")
INFOS = [".", "DP=3;AF=0.1,.,1e-3;DB", "DP=.;AF=.;NOTE=a=b,.,c", "DP=;AF=", "DB;DB", "DB=7;DP=+5", "DP=-2147483645;AF=NaN,Infinity", "DP=99999999999;X=1", "NOTE;DP= 4", "AF=1e300,1.00000000000000001", ";DP=1;", "AF=-0.0"]
FORMATS = [("GT:DP:AD:GL:FT", "0/1:3:1,2:-0.5,.,-1e-2:q", ".:.:.:.:."), ("DP:GT", "7:/0|1", ":|2"), ("GT", "./.", "0|1/2"), ("AD:GT:DP", "1,.,+3:10|.:9999999999", ""), ("XX", "1", "2"), ("GT:GT:AD", "1:0:007", "0:1"), ("GT:DP", "0 /1: 5", "-2147483648/1"), ("FT:GT", ":", "x:0/1:more")]


def records(spark):
    rows, n = [], 0
    for info in INFOS:
        for keys, *texts in FORMATS:
            rows.append((n, "\t".join(["chr1", str(n + 1), ".", "A", "C", "0.5", "PASS", info, keys, *texts])))
            n += 1
    return spark.createDataFrame(rows, "row_id long, value string").coalesce(1)


def test_batches_and_expressions_agree(spark, monkeypatch):
    lines = records(spark)
    fast = vcf.parse_records(lines, HEADER)
    monkeypatch.setattr(vcf, "_read_in_batches", lambda text, otherwise, *rest: otherwise)
    slow = vcf.parse_records(lines, HEADER)
    assert [f.dataType for f in fast.schema] == [f.dataType for f in slow.schema] or fast.schema.simpleString() == slow.schema.simpleString()
    text = lambda df: [repr(r) for r in df.orderBy("row_id").collect()]
    got = text(fast)
    assert got == text(slow) and len(got) == len(INFOS) * len(FORMATS)


def test_plain_lines_need_no_expression(spark, monkeypatch):
    monkeypatch.setattr(vcf, "_read_in_batches", lambda text, otherwise, *rest, f=vcf._read_in_batches: f(text, F.raise_error(F.lit("an expression was needed")).cast("void"), *rest))
    lines = spark.createDataFrame([(0, "chr1\t5\t.\tA\tC\t.\tPASS\tDP=3;AF=0.25;DB\tGT:DP:AD\t0/1:3:1,2\t.|.:.:.")], "row_id long, value string")
    r = vcf.parse_records(lines, HEADER).collect()[0]
    assert (r.info.DP, r.info.AF, r.info.DB, r.info.NOTE) == (3, [0.25], True, None)
    assert [(s.GT.alleles, s.GT.phased, s.DP, s.AD, s.FT) for s in r.samples] == [([0, 1], [False, False], 3, [1, 2], None), ([None, None], [True, True], None, None, None)]


@pytest.mark.parametrize("line", ["chr1\t5\t.\tA\tC\t.\tPASS\tDP=3\tGT\t0/1", "chr1\t5\t.\tA\tC\t.\tPASS\tDP=x\tGT\t0/1\t0/1", "chr1\t5\t.\tA\tC\t.\tPASS\tDP=1;DP=2\tGT\t0/1\t0/1", "chr1\t5\t.\tA\tC\t.\tPASS\tDP=1\tGT\t0//1\t0/1"])
def test_wrong_lines_still_fail(spark, line):
    with pytest.raises(Exception):  # noqa: B017
        vcf.parse_records(spark.createDataFrame([(0, line)], "row_id long, value string"), HEADER).collect()


def test_what_is_moved_and_sorted_is_lines(spark, monkeypatch):
    monkeypatch.setattr(vcf, "PART_ROWS", 50)
    r = random.Random(1)
    places = [(k, r.choice([None, 0, 1, 2]), r.choice([5, r.randrange(1, 900)])) for k in range(400)]
    rows = spark.createDataFrame(places, "row_id long, contig_idx int, pos int").selectExpr("row_id", "contig_idx", "'chr1' AS chrom", "pos", "array() AS ids", "'A' AS ref", "array('C') AS alts", "float(null) AS qual", "array() AS filters", "named_struct('DP', int(row_id)) AS info")
    out = vcf.record_lines(rows, HEADER.with_(infos={"DP": HEADER.infos["DP"]}, formats={}, samples=()))
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    moved = next(i for i, line in enumerate(plan) if "Repartition" in line)
    assert not any("concat_ws" in line for line in plan[:moved]) and "concat_ws" in plan[moved + 1]
    parts = [[int(x.value.rsplit("=")[-1]) for x in p] for p in out.rdd.glom().collect()]
    assert sum(map(bool, parts)) == 4
    assert sum(parts, []) == [k for k, _, _ in sorted(places, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[0]))]


def test_numbers_are_spelled_as_with_six_digits(spark):
    values = [0.1, 0.7, 1.0, 3.0, 100000.0, 999999.0, 999999.5, 1e6, 1234567.0, 0.001, 0.0001, 0.00001234, 123.456, 123456.7, 0.333333343, -0.5, -12.25, 0.0, 99999.99, 1e30, 5.5e-7, 2.0000001, 1.10, math.inf, -math.inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    for kind in ("float", "double"):
        got = [(r.v, r.t) for r in df.orderBy("k").select(F.col("v").cast(kind).alias("v")).select("v", number_text(F.col("v"), True).alias("t")).collect()]
        assert [t for _, t in got] == ["%g" % v for v, _ in got]
