"""BCF against its own bytes, the rows it came from, and hand-made records."""

import struct

import pytest

from variform.sources import bcf, bgzf
from variform.sources.derived import HEADER, variants
from variform.sources.header import VariantHeader
from variform.sources.vcf import join_parts

SF = "/root/testdata/sf0.001"
TEXT = """##fileformat=VCFv4.3
##FILTER=<ID=PASS,Description="ok">
##FILTER=<ID=q10,Description="low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="">
##INFO=<ID=AF,Number=A,Type=Float,Description="">
##INFO=<ID=DB,Number=0,Type=Flag,Description="">
##INFO=<ID=S,Number=.,Type=String,Description="">
##INFO=<ID=END,Number=1,Type=Integer,Description="">
##FORMAT=<ID=GT,Number=1,Type=String,Description="">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="">
##FORMAT=<ID=N,Number=1,Type=String,Description="">
##contig=<ID=1,length=300000000>
##contig=<ID=2>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"""
HEAD = VariantHeader.parse(TEXT)


def row(i, **changes):
    sample = {"GT": {"alleles": [0, 1], "phased": [False, False]}, "DP": 3, "PL": [1, 2, 3], "GL": [-0.5, None, 0.25], "N": "x"}
    empty = {"GT": {"alleles": [None], "phased": [True]}, "DP": None, "PL": None, "GL": None, "N": None}
    info = {"DP": 5, "AF": [0.5], "DB": True, "S": ["a", None, "b"], "END": None}
    base = {"row_id": i, "contig_idx": 0, "chrom": "1", "pos": i + 1, "ids": ["rs1", "rs2"], "ref": "A", "alts": ["C"], "qual": 30.5, "filters": ["PASS"], "info": info, "samples": [sample, empty]}
    return base | changes


ROWS = [
    row(0), row(1, ids=[], alts=[], qual=None, filters=[], info={"DP": None, "AF": None, "DB": False, "S": None, "END": None}), row(2, contig_idx=1, chrom="2", pos=7, filters=["q10"]), row(3, ref="A" * 20, alts=["C" * 300, "<DEL>", "*"], pos=299_999_999),
    row(4, info=row(4)["info"] | {"DP": -32761, "AF": [0.1, None, 1e-3], "END": 400}),
    row(5, samples=[row(5)["samples"][0] | {"GT": {"alleles": [None, 2, 1], "phased": [True, True, False]}, "DP": 70000, "PL": [0, 200, 40000], "N": "ünïcode"}, row(5)["samples"][1] | {"GT": {"alleles": [1], "phased": [True]}, "PL": [7, None]}]),
]


def as_float32(value):
    if isinstance(value, dict):
        return {k: as_float32(v) for k, v in value.items()}
    if isinstance(value, list):
        return [as_float32(v) for v in value]
    return struct.unpack("<f", struct.pack("<f", value))[0] if isinstance(value, float) else value


def test_records_come_back():
    encoder, decoder = bcf.Encoder(HEAD), bcf.Decoder(HEAD, TEXT)
    data = b"".join(encoder.record(r) for r in ROWS)
    assert list(decoder.chunk(0, data)) == as_float32(ROWS)
    assert encoder.head()[:5] == b"BCF\x02\x02" and encoder.head().endswith(b"\tb\n\0")


def test_bytes_are_those_of_the_format():
    shared = struct.pack("<iiiIII", 0, 9, 1, 0x7F800001, 2 << 16 | 1, 1 << 24 | 2) + b"\x17.\x17A\x17C" + b"\x11\x01" + b"\x11\x02\x11\x05"
    own = b"\x11\x07" + b"\x21\x02\x05\x00\x81"
    r = bcf.Decoder(HEAD, TEXT).record(0, shared, own)
    assert (r["chrom"], r["pos"], r["ids"], r["ref"], r["alts"], r["qual"], r["filters"], r["info"]["DP"]) == ("1", 10, [], "A", ["C"], None, ["q10"], 5)
    assert [s["GT"] for s in r["samples"]] == [{"alleles": [0, 1], "phased": [True, True]}, {"alleles": [None], "phased": [True]}]
    made = bcf.Encoder(HEAD).record(r | {"samples": [{"GT": s["GT"]} for s in r["samples"]]})
    assert made == struct.pack("<II", len(shared), len(own)) + shared + own
    with pytest.raises(ValueError, match="samples"):
        bcf.Decoder(HEAD, TEXT).record(0, shared[:20] + struct.pack("<I", 3) + shared[24:], b"")


def test_dictionary_numbers():
    text = TEXT.replace('##INFO=<ID=AF,Number=A,Type=Float,Description="">', '##INFO=<ID=AF,Number=A,Type=Float,Description="",IDX=20>')
    strings, contigs = bcf.dictionary(text)
    assert strings[:3] == ["PASS", "q10", "DP"] and strings[20] == "AF" and contigs == ["1", "2"] and strings[21] == "DB"


@pytest.mark.parametrize("compress", [True, False])
def test_files(spark, tmp_path, compress):
    df = variants(spark, SF)
    bcf.write_bcf(df.repartition(4), HEADER, str(tmp_path / "out"), compress=compress)
    join_parts(spark, str(tmp_path / "out"), str(tmp_path / "x.bcf"))
    data = (tmp_path / "x.bcf").read_bytes()
    assert data.endswith(bgzf.EOF_BLOCK) == compress and (data[:3] == b"BCF") != compress
    back, header = bcf.read_bcf(spark, str(tmp_path / "x.bcf"))
    assert header.lines() == HEADER.lines() and back.rdd.getNumPartitions() > 1
    want = [r.asDict(True) for r in df.orderBy("contig_idx", "pos", "row_id").collect()]
    got = [r.asDict(True) for r in back.orderBy("row_id").collect()]
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        for s in w["samples"]:
            s["GT"]["phased"][0] = s["GT"]["phased"][1]
        assert g == w | {"row_id": i}
    (tmp_path / "cut.bcf").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off"):
        bcf.read_bcf(spark, str(tmp_path / "cut.bcf"))[0].collect()
    with pytest.raises(ValueError, match="exists"):
        bcf.write_bcf(df, HEADER, str(tmp_path / "out"), compress=compress)
