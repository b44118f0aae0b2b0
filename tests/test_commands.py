"""Commands on files, and their summaries."""

import json

import pytest

from variform import commands
from variform.sources import bcf

HEAD = """##fileformat=VCFv4.3
##FILTER=<ID=PASS,Description="All filters passed">
##FILTER=<ID=q10,Description="low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Count">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##contig=<ID=1,length=1000>
##contig=<ID=2,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"""
BODY = [
    "1\t10\trs1\tA\tC\t50\tPASS\tDP=20;AC=1\tGT:DP\t0/1:9\t0/0:3", "1\t20\t.\tAT\tA,ATT\t10\tq10\tDP=5;AC=1,1\tGT:DP\t1/2:9\t0/0:12", "1\t20\t.\tAT\tA\t5\tPASS\tDP=9;AC=0\tGT:DP\t0/0:1\t0/0:2",
    "2\t5\t.\tG\tT\t.\t.\tDP=30;AC=2\tGT:DP\t./.:.\t1|1:7",
]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in.vcf").write_text(HEAD + "\n" + "\n".join(BODY) + "\n")
    (tmp_path / "ann.tsv").write_text("1\t10\tA\tC\t77\n1\t20\tAT\tATT\t88\n")
    (tmp_path / "x.bed").write_text("1\t9\t10\n")
    (tmp_path / "ref.fa").write_text(">1\n" + "GCGCGCGCGACGCGCGCGCATTTGCGC" + "\n>2\nAAAAGAAAA\n")
    return tmp_path


def run(spark, files, *arguments, out="out.vcf"):
    summary = commands.run(spark, [arguments[0], str(files / "in.vcf"), *map(str, arguments[1:]), "-o", str(files / out), "--single"])
    json.dumps(summary)
    return summary, (files / out).read_text().splitlines()


def body(lines):
    return [line for line in lines if not line.startswith("#")]


def test_view_and_filter(spark, files):
    summary, lines = run(spark, files, "view", "-r", "1:10-15,2", "-s", "b")
    assert summary == {"read": 4, "written": 2} and lines[-3].endswith("FORMAT\tb") and [x.split("\t")[-1] for x in body(lines)] == ["0/0:3", "1|1:7"]
    summary, lines = run(spark, files, "view", "-v", "indels", "-H", out="b")
    assert summary["written"] == 2 and lines == BODY[1:3]
    summary, lines = run(spark, files, "view", "--header-only", out="c")
    assert body(lines) == [] and lines[-1].startswith("#CHROM")
    summary, lines = run(spark, files, "filter", "-i", "INFO/DP >= 9 & QUAL > 7", "-s", "LOW", "-m", "+", out="d")
    assert summary == {"read": 4, "written": 4, "passed": 1} and [x.split("\t")[6] for x in body(lines)] == ["PASS", "q10;LOW", "LOW", "LOW"]
    summary, lines = run(spark, files, "filter", "-e", "QUAL < 20", "-g", "3", out="e")
    assert [x.split("\t")[1] for x in body(lines)] == ["10", "5"]


def test_norm(spark, files):
    _, lines = run(spark, files, "norm", "-m", "--rm-dup", "exact")
    assert [x.split("\t")[3:5] for x in body(lines)] == [["A", "C"], ["AT", "A"], ["AT", "ATT"], ["G", "T"]]
    _, lines = run(spark, files, "norm", "-m", "-i", 'QUAL > 20', out="b")
    assert body(lines) == [x.replace("PASS\tDP=20", "PASS\tDP=20") for x in BODY]
    _, lines = run(spark, files, "norm", "-f", files / "ref.fa", "--check-ref", "s", out="c")
    assert len(body(lines)) == 4 and body(lines)[0].split("\t")[3] == "A"


def test_annotate_setgt_reheader(spark, files):
    summary, lines = run(spark, files, "annotate", "-a", files / "ann.tsv", "-c", "CHROM,POS,REF,ALT,INFO/DP", "-I", "+%CHROM\\_%POS")
    assert summary == {"read": 4, "written": 4, "changed": 4 - 0} and [x.split("\t")[7].split(";")[0] for x in body(lines)] == ["DP=77", "DP=88", "DP=9", "DP=30"]
    summary, lines = run(spark, files, "annotate", "-a", files / "x.bed", "-c", "CHROM,FROM,TO", "-m", "+HIT", out="b")
    assert ["HIT" in x for x in body(lines)] == [True, False, False, False]
    summary, lines = run(spark, files, "setgt", "-t", "q", "-i", "FMT/DP < 8", "-n", ".", out="c")
    assert summary == {"read": 4, "written": 4, "genotypes": 4, "alleles": 8} and [x.split("\t")[-1].split(":")[0] for x in body(lines)] == ["./.", "0/0", "./.", "./."]
    (files / "names").write_text("a x\n")
    _, lines = run(spark, files, "reheader", "-s", files / "names", out="d")
    assert lines[len(lines) - 5].endswith("\tx\tb")


def test_query_head_index_validate(spark, files, capsys):
    summary = commands.run(spark, ["query", str(files / "in.vcf"), "-f", "%POS[ %SAMPLE=%DP]", "-i", "QUAL > 1", "--print-header", "-o", str(files / "q")])
    assert summary == {"records": 3} and "".join(p.read_text() for p in sorted((files / "q").glob("part-*"))) == "#[1]POS [2]a:SAMPLE=[3]a:DP [4]b:SAMPLE=[5]b:DP\n10 a=9 b=3\n20 a=9 b=12\n20 a=1 b=2\n"
    assert commands.run(spark, ["head", str(files / "in.vcf"), "--header-lines", "2", "-n", "1", "--from-chrom"]) == {"header_lines": 3, "records": 1}
    assert capsys.readouterr().out.splitlines()[-1] == BODY[0]
    assert commands.run(spark, ["index", str(files / "in.vcf")]) == {"records": 4} and capsys.readouterr().out == "1\t1000\t3\n2\t1000\t1\n"
    report = commands.run(spark, ["validate", str(files / "in.vcf")])
    assert (report["records"], report["errors"], report["warnings"]) == (4, 1, 1) and [d["code"] for d in report["diagnostics"]] == ["header.reference", "record.duplicate-variant"]


def test_bcf_is_read_by_content(spark, files):
    for kind in "bu":
        commands.run(spark, ["view", str(files / "in.vcf"), "-O", kind, "-o", str(files / kind), "--single"])
        df, header = commands.read(spark, str(files / kind))
        assert header.samples == ("a", "b") and df.count() == 4
    assert (files / "u").read_bytes()[:5] == bcf.MAGIC
    commands.run(spark, ["view", str(files / "b"), "-H", "-o", str(files / "back"), "--single"])
    assert (files / "back").read_text().splitlines() == BODY
