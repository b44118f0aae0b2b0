"""Truth tables of the expression language on one record."""

import pytest

from variform.functions.expression import ExpressionError, compile_truth
from variform.functions.stats import binom_p, fisher_p
from variform.sources.header import VariantHeader
from variform.sources.vcf import parse_records

HEADER = """##fileformat=VCFv4.3
##contig=<ID=chr1,length=1000>
##FILTER=<ID=q10,Description="low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="">
##INFO=<ID=AF,Number=A,Type=Float,Description="">
##INFO=<ID=M,Number=2,Type=Integer,Description="">
##INFO=<ID=X,Number=1,Type=Integer,Description="">
##INFO=<ID=DB,Number=0,Type=Flag,Description="">
##INFO=<ID=S,Number=.,Type=String,Description="">
##FORMAT=<ID=GT,Number=1,Type=String,Description="">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
"""
RECORD = "chr1\t10\trs1;rs2\tA\tC,AT\t50\tq10\tDP=20;AF=0.1,0.5;M=3,.;DB;S=foo,Bar\tGT:DP:AD\t0/1:5:1,2,3\t1|2:30:4,5,6\t./.:.:."

CASES = [
    ("INFO/DP = 20", True), ("QUAL > 50", False), ("POS % 3 = 1", True), ("INFO/AF = 0.1", True), ("INFO/AF[1] = 0.5", True), ("INFO/AF[0] = 0.5", False), ("INFO/AF[5] = \".\"", True),
    ('ID = "rs2"', True), ('ID != "rs2"', True), ('ALT = "AT"', True), ("ILEN = 1", True), ('TYPE ~ "indel"/i', True), ('FILTER ~ "q10"', True), ('FILTER = "."', False),
    ("X = 1", False), ('X = "."', True), ('SUM(X) = "."', True), ("X != 1", True), ("M[1] = 3", False), ('M = "."', True), ("COUNT(M) = 2", True), ("COUNT(X) = 0", True), ("DB = 1", True),
    ('S ~ "^b"/i', True), ('S !~ "^foo$"', True), ("STRLEN(S) = 3", True), ("N_ALT = 2", True), ("N_SAMPLES = 3", True), ("AN = 4", True), ("AC[0] = 2", True), ("MAC = 1", True), ("MAF = 0.25", True), ("N_MISSING = 1", True),
    ('GT = "het"', True), ('GT[0] = "Aa"', False), ('GT[1] = "Aa"', True), ('GT[2] = "mis"', True), ('GT = "1|2"', True), ('GT = "hom"', False), ('GT ~ "\\|"', True),
    ("FMT/DP > 10 & FMT/DP < 10", False), ("FMT/DP > 10 && FMT/DP < 10", True), ("FMT/AD[1:2] = 6", True), ("FMT/AD[0:2] = 6", False), ("FMT/AD[:0] = 4", True), ("FMT/AD[GT] = 6", True), ("FMT/AD[0:GT] = 3", False),
    ("MAX(FMT/DP) = 30", True), ("SMPL_MAX(FMT/AD) = 3", True), ("AVG(FMT/DP) = 17.5", True), ("MEDIAN(INFO/AF) = 0.3", True), ("STDEV(FMT/DP) = 12.5", True), ("N_PASS(FMT/DP > 10) = 1", True), ("F_PASS(GT[0,1]=\"het\") = 1", True),
    ('COUNT(GT="het") = 2', True), ("INFO/DP / 0 > 1", True), ("-INFO/DP < 0", True), ("INFO/DP - 10 * 2 = 0", True), ("ABS(5 - INFO/DP) = 15", True), ("PHRED(INFO/AF) = 10", True), ("BINOM(FMT/AD) > 0.9", True),
    ("QUAL = 1 || QUAL = 50 && POS = 10", True), ("QUAL = 50 | QUAL = 1 && POS = 11", True), ('FMT/DP = "."', True),
]


@pytest.fixture(scope="module")
def row(spark):
    header = VariantHeader.parse(HEADER)
    return parse_records(spark.createDataFrame([(0, RECORD)], "row_id long, value string"), header).cache(), header


def test_truths(row):
    df, header = row
    wrong = []
    for at in range(0, len(CASES), 12):
        part = CASES[at : at + 12]
        got = df.select(*[compile_truth(text, header).site.alias(f"c{i}") for i, (text, _) in enumerate(part)]).first()
        wrong += [(text, got[i]) for i, (text, want) in enumerate(part) if got[i] is not want]
    assert not wrong


@pytest.mark.parametrize("text", ["QUAL", "DP = 1", "QUAL > ", "1 < 2 < 3", 'FILTER = "PASS"', 'QUAL = "x"', "NOPE = 1", "(QUAL > 1", "QUAL > .", 'QUAL ~ "x"', "GT = 1", "N_PASS(QUAL > 1) = 1", "@x = 1", "FOO(QUAL) = 1", "(QUAL > 1) + 1 = 2", "FMT/DP[7] = 1"])
def test_errors(text):
    with pytest.raises(ExpressionError):
        compile_truth(text, VariantHeader.parse(HEADER))


def test_samples_of_logic(row):
    df, header = row
    for text, want in (("FMT/DP > 10 & FMT/DP < 50", [False, True, False]), ("FMT/DP > 10 && FMT/DP < 10", [True, True, False]), ("FMT/DP > 10 | FMT/DP < 10", [True, True, False]), ("FMT/DP > 10 || QUAL > 1", [True, True, True]), ("FMT/DP[0] < 10", [True, False, False])):
        assert df.select(compile_truth(text, header).passes.alias("p")).first().p == want, text


def test_statistics():
    assert binom_p(5, 5) == 1.0 and binom_p(0, 0) is None and abs(binom_p(1, 9) - 0.021484375) < 1e-12
    assert abs(binom_p(900, 1300) / 1.2e-17 - 1) < 1 and abs(fisher_p(1, 9, 11, 3) - 0.002759456) < 1e-8
    with pytest.raises(ValueError):
        binom_p(-1, 2)
