"""VCF files in and out: compression by content, ranges of blocks, header modes, one commit."""

import gzip
import io
import random

import pytest

from variform.sources import bgzf
from variform.sources.header import VariantHeader
from variform.sources.vcf import join_parts, output_lines, read_header, read_lines, read_vcf, write_vcf

HEAD = """##fileformat=VCFv4.3
##FILTER=<ID=PASS,Description="All filters passed">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=NOTE,Number=1,Type=String,Description="Text">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##contig=<ID=chr1,length=1000000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"""


def body(n=400, seed=1):
    r = random.Random(seed)
    note = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([1, 5, 400])))
    return [f"chr1\t{i + 1}\t.\tA\tC\t50\tPASS\tDP={i};NOTE={note()}\tGT\t0/1\t1|1" for i in range(n)]


def blocked(text: bytes, size: int) -> bytes:
    return b"".join(bgzf.block(text[i : i + size]) for i in range(0, len(text), size)) + bgzf.EOF_BLOCK


def test_ranges_of_blocks_give_every_line_once():
    r = random.Random(3)
    for trial in range(30):
        lines = [("x" * r.choice([0, 1, 30, 700])).encode() for _ in range(r.randint(1, 60))]
        text = b"\n".join(lines) + (b"\n" if trial % 2 else b"")
        data = blocked(text, r.choice([7, 100, 1000]))
        for step in (40, 333, 10_000):
            got = [x for a in range(0, len(data), step) for x in bgzf.lines(io.BytesIO(data), a, min(len(data), a + step), len(data))]
            want = text.split(b"\n")
            assert got == (want[:-1] if want[-1] == b"" else want)
    assert gzip.decompress(blocked(b"abc" * 50_000, bgzf.PAYLOAD)) == b"abc" * 50_000 and gzip.decompress(bgzf.EOF_BLOCK) == b""
    noise = random.Random(1).randbytes(bgzf.PAYLOAD)
    assert gzip.decompress(bgzf.block(noise)) == noise and len(bgzf.block(noise)) <= 0x10000
    with pytest.raises(ValueError):
        list(bgzf.lines(io.BytesIO(data[:-30]), 0, len(data), len(data) - 30))


@pytest.mark.parametrize("name, pack", [("x.vcf", lambda t: t), ("x.vcf.gz", gzip.compress), ("plain-name", gzip.compress), ("x.vcf.bgz", lambda t: blocked(t, 3000)), ("y.vcf.gz", lambda t: blocked(t, 3000))])
def test_compression_is_known_by_content(spark, tmp_path, name, pack):
    text = HEAD + "\n" + "\n".join(body()) + "\n"
    (tmp_path / name).write_bytes(pack(text.encode()))
    df, header = read_vcf(spark, str(tmp_path / name), split_bytes=5000)
    assert header.lines() == HEAD.split("\n")
    rows = df.orderBy("row_id").collect()
    assert [r.pos for r in rows] == list(range(1, 401)) and [r.info.DP for r in rows] == list(range(400))
    assert [r.value for r in output_lines(df, header).collect()][1:] == body()


@pytest.mark.parametrize("compress", [False, "gzip", "bgzf"])
def test_parts_are_one_valid_file(spark, tmp_path, compress):
    text = HEAD + "\n" + "\n".join(body()) + "\n"
    (tmp_path / "in.vcf").write_text(text)
    df, header = read_vcf(spark, str(tmp_path / "in.vcf"))
    out = tmp_path / "out"
    write_vcf(df.repartition(3), header, str(out), compress=compress)
    assert (out / "_SUCCESS").exists() and sorted(p.name for p in tmp_path.iterdir()) == ["in.vcf", "out"]
    join_parts(spark, str(out), str(tmp_path / "one"))
    data = (tmp_path / "one").read_bytes()
    assert (gzip.decompress(data) if compress else data).decode() == text
    if compress == "bgzf":
        assert data.endswith(bgzf.EOF_BLOCK) and bgzf.block_size(data, 0)
    back, again = read_vcf(spark, str(out))
    assert again == header and sorted(r.pos for r in back.collect()) == list(range(1, 401))
    with pytest.raises(Exception, match="(?i)exists"):
        write_vcf(df, header, str(out), compress=compress)
    write_vcf(df.limit(5), header, str(out), compress=compress, overwrite=True, header_mode="none")
    texts = [gzip.decompress(p.read_bytes()) if compress else p.read_bytes() for p in sorted(out.glob("part-*"))]
    assert b"".join(texts).decode() == "\n".join(body()[:5]) + "\n"
    with pytest.raises(ValueError):
        write_vcf(back, again, str(out), compress=compress, overwrite=True)


def test_header_only_and_head_reads_no_record(spark, tmp_path):
    (tmp_path / "in.vcf").write_text(HEAD + "\nthis is no record\n")
    header = read_header(spark, str(tmp_path / "in.vcf"))
    assert header == VariantHeader.parse(HEAD)
    df, _ = read_vcf(spark, str(tmp_path / "in.vcf"))
    write_vcf(df, header, str(tmp_path / "h"), header_mode="only")
    assert "".join(p.read_text() for p in (tmp_path / "h").glob("part-*")) == HEAD + "\n"


def test_parts_of_a_folder_are_read_in_ranges_and_in_order(spark, tmp_path):
    # parts grow, so an order by size is the wrong one; the last is large enough for many ranges
    texts = [[f"{i} {j} {'x' * (j % 50)}" for j in range(n)] for i, n in enumerate([1, 40, 0, 300, 20_000])]
    for i, lines in enumerate(texts):
        (tmp_path / f"part-{i:05d}.vcf.gz").write_bytes(blocked("".join(f"{x}\n" for x in lines).encode(), 3000))
    df = read_lines(spark, str(tmp_path), 10_000)
    rows = df.orderBy("row_id").collect()
    assert [r.value for r in rows] == sum(texts, []) and len({r.row_id for r in rows}) == len(rows)
    assert sum(map(bool, df.rdd.glom().map(len).collect())) > 4
    assert len(df.inputFiles()) == len(texts)


def test_a_folder_may_hold_parts_of_other_kinds(spark, tmp_path):
    lines = [f"{i} é {'x' * (i % 700)}" for i in range(9000)]
    text = lambda a, b: "\n".join(lines[a:b]).encode()
    (tmp_path / "a.vcf.gz").write_bytes(blocked(text(0, 2000) + b"\n", 5000))
    (tmp_path / "b.vcf").write_bytes(text(2000, 6000))
    (tmp_path / "c.vcf.gz").write_bytes(gzip.compress(text(6000, 6100)) + gzip.compress(b"\n" + text(6100, 8000)))
    (tmp_path / "d.vcf").write_bytes(b"")
    (tmp_path / "e f%20 é.vcf.gz").write_bytes(blocked(text(8000, 9000), 5000))
    for split in (10_000, 64 << 20):
        assert [r.value for r in read_lines(spark, str(tmp_path), split).orderBy("row_id").collect()] == lines


def test_one_blocked_file_is_not_written_on(spark, tmp_path):
    path = tmp_path / "in.vcf.gz"
    path.write_bytes(blocked((HEAD + "\n" + "\n".join(body(20)) + "\n").encode(), 3000))
    df, header = read_vcf(spark, str(path))
    with pytest.raises(ValueError, match="read from"):
        write_vcf(df, header, str(path), compress="bgzf", overwrite=True)
    assert sorted(r.pos for r in read_vcf(spark, str(path))[0].collect()) == list(range(1, 21))


def test_a_line_that_is_no_utf8_is_read_as_in_a_plain_file(spark, tmp_path):
    text = b"one\ntwo \xff\nthree\n"
    (tmp_path / "x.txt").write_bytes(text)
    (tmp_path / "x.txt.gz").write_bytes(blocked(text, 5))
    read = lambda name: [r.value for r in read_lines(spark, str(tmp_path / name)).orderBy("row_id").collect()]
    assert read("x.txt.gz") == read("x.txt")


@pytest.mark.parametrize("compress", [False, "bgzf"])
def test_conditions_on_rows_meet_no_comment(spark, tmp_path, compress):
    (tmp_path / "in.vcf").write_text(HEAD + "\n\n" + "\n".join(body(30)) + "\n")
    df, header = read_vcf(spark, str(tmp_path / "in.vcf"))
    write_vcf(df, header, str(tmp_path / "out"), compress=compress)
    for path in ("in.vcf", "out"):
        rows = read_vcf(spark, str(tmp_path / path))[0].where("(chrom = 'chr1' AND pos BETWEEN 10 AND 15) OR chrom = 'chr2' OR (contig_idx = 0 AND pos < 3)")
        assert sorted(r.pos for r in rows.collect()) == [1, 2, *range(10, 16)]
