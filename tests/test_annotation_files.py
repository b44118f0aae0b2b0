"""GFF3 transcripts and FASTA pieces."""

import random

import pytest

from variform.sources.vcf import read_fasta, read_transcripts


def gff(*rows):
    return "##gff-version 3\n" + "\n".join("\t".join(map(str, r)) for r in rows) + "\n"


GENE = ("1", "x", "gene", 1, 100, ".", "+", ".", "ID=gene:g1;biotype=protein_coding")


def transcript(seq="1", kind="mRNA", start=5, end=50, strand="+", attributes="ID=transcript:t1;Parent=gene:g1"):
    return (seq, "x", kind, start, end, ".", strand, ".", attributes)


def test_transcripts(spark, tmp_path):
    rows = [
        GENE, transcript(), transcript(kind="MRNA", strand="-", attributes="ID=t2;Parent=g1"), transcript(kind="transcript", strand="?", attributes="ID=t3;Parent=g1;biotype=lncRNA"), transcript(kind="transcript", attributes="ID=t4;Parent=g1;biotype=LNCRNA"),
        transcript(kind="exon", attributes="Parent=t1"), transcript(kind="three_prime_UTR", attributes="x=y"), transcript(kind="other", attributes="x=y"), ("1", "x", "region", 1, 9, ".", ".", ".", ""),
    ]
    (tmp_path / "a.gff").write_text(gff(*rows))
    assert sorted((r.start, r.end, str(r.reverse)) for r in read_transcripts(spark, str(tmp_path / "a.gff")).collect()) == [(5, 50, "False"), (5, 50, "None"), (5, 50, "True")]
    assert read_transcripts(spark, str(tmp_path / "a.gff"), {"LNCRNA"}).count() == 1


@pytest.mark.parametrize("rows, message", [
    ([GENE, GENE], "repeated gene"), ([GENE, transcript(), transcript()], "repeated transcript"), ([GENE, transcript(attributes="Parent=g1")], "without ID"), ([GENE, transcript(attributes="ID=t")], "without Parent"),
    ([transcript()], "without its gene"), ([GENE, transcript(seq="2")], "another sequence"), ([GENE, transcript(strand="x")], "bad strand"), ([GENE, transcript(start=9, end=3)], "empty interval"), ([GENE, transcript(start="x")], "bad position"),
    ([GENE, transcript(attributes="ID")], "bad attribute"), ([("1", "x")], "nine columns"), ([GENE, transcript(attributes="ID=t;ID=u;Parent=g1")], "(?i)duplicate"),
])
def test_bad_transcripts_fail(spark, tmp_path, rows, message):
    if message == "repeated gene":
        rows = [*rows, transcript()]
    (tmp_path / "a.gff").write_text(gff(*rows))
    with pytest.raises(Exception, match=message):
        read_transcripts(spark, str(tmp_path / "a.gff")).collect()


@pytest.mark.parametrize("width, chunk", [(7, 10), (60, 16), (1000, 64), (13, 1000)])
def test_fasta_pieces(spark, tmp_path, width, chunk):
    r = random.Random(width)
    seqs = {f"chr{k}": "".join(r.choice("ACGTacgtN") for _ in range(n)) for k, n in enumerate([1, 10, 640, 333])}
    text = "".join(f">{name} some words\n" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width)) for name, seq in seqs.items())
    (tmp_path / "a.fa").write_text(text)
    got = {(x.chrom, x.chunk): x.seq for x in read_fasta(spark, str(tmp_path / "a.fa"), chunk).collect()}
    assert got == {(name, i // chunk): seq[i : i + chunk] for name, seq in seqs.items() for i in range(0, len(seq), chunk)}
