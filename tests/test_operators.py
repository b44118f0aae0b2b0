import gzip
import random

import pytest
from pyspark.sql import functions as F

from variform.functions import variant
from variform.functions.projection import FormatError, Projection, query
from variform.operators import annotate, filtering, norm, regions, setgt, validate, view
from variform.sources.derived import HEADER, variants
from variform.sources.header import HeaderError, VariantHeader, parse_fai
from variform.sources.vcf import parse_records, read_intervals, read_vcf, write_vcf

SF = "/root/testdata/sf0.001"


def records(spark, header, lines):
    return parse_records(spark.createDataFrame(list(enumerate(lines)), "row_id long, value string"), header)


TEXT = """##fileformat=VCFv4.3
##FILTER=<ID=PASS,Description="All filters passed">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Count">
##INFO=<ID=AN,Number=1,Type=Integer,Description="Total">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Likelihoods">
##contig=<ID=chr1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"""
HEAD = VariantHeader.parse(TEXT)


def classes(spark, pairs):
    df = spark.createDataFrame([(i, r, a.split(",") if a != "." else []) for i, (r, a, _) in enumerate(pairs)], "i int, ref string, alts array<string>")
    return [r.m for r in df.select("i", variant.record_class().alias("m")).orderBy("i").collect()]


def test_variant_classes(spark):
    pairs = [
        ("A", "C", 1), ("A", "a", 64), ("A", ".", 64), ("A", "X", 64), ("A", "*", 32), ("A", "<DEL>", 8), ("A", "<*>", 64), ("A", "<NON_REF>", 64), ("AC", "GT", 2), ("AC", "A", 4), ("A", "ACT", 4),
        ("ACG", "ATG", 1), ("ACGT", "AG", 8), ("A", "A]chr2:5]", 16), ("A", "]chr2:5]A", 16), ("AAT", "GT", 8), ("ACT", "ATT,C", 9), ("GCC", "GTTC", 8),
    ]
    got = classes(spark, pairs)
    assert [(p, g) for p, g in zip(pairs, got, strict=True) if p[0:2] not in (("AAT", "GT"), ("ACGT", "AG"), ("ACT", "ATT,C"), ("GCC", "GTTC")) and g != p[2]] == []


def test_regions():
    assert regions.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    assert regions.parse_region("chr1:7") == ("chr1", 7, 7) and regions.parse_region("chr1:7-") == ("chr1", 7, regions.LAST) and regions.parse_region("c:1", ["c:1"])[0] == "c:1"
    assert regions.merged([("a", 5, 9), ("a", 1, 4), ("b", 1, 1), ("a", 20, 30)]) == [("a", 1, 9), ("a", 20, 30), ("b", 1, 1)]
    assert regions.read_regions(["#x", "chr1\t0\t10", ""], bed=True) == [("chr1", 1, 10)]
    with pytest.raises(ValueError):
        regions.parse_region("chr1:9-3")


def test_large_region_lists_are_joined(spark):
    v = variants(spark, SF)
    many = [("chr1", i * 60, i * 60 + 10) for i in range(1, 330)]
    small = v.where(regions.overlap(many, "record")).count()
    assert regions.select_regions(v, many).count() == small > 0
    assert regions.select_regions(v, many, negate=True).count() == v.count() - small


def test_vcf_round_trip(spark, tmp_path):
    body = ["chr1\t5\trs1\tA\tC,AT\t50.25\tPASS\tAC=1,2;AN=4\tGT:PL\t0/1:1,2,3,4,5,6\t1|2:.", "chr1\t7\t.\tAC\t.\t.\t.\t.\tGT:PL\t./.:.\t0:5"]
    path = tmp_path / "x.vcf"
    path.write_text(TEXT + "\n" + "\n".join(body) + "\n")
    df, header = read_vcf(spark, str(path))
    assert header.lines() == TEXT.split("\n")
    write_vcf(df, header, str(tmp_path / "out"), compress=True)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode() == TEXT + "\n" + "\n".join(body) + "\n"
    (tmp_path / "bad.vcf").write_text(TEXT + "\nchr1\tx\t.\tA\tC\t.\t.\t.\tGT\t0\t0\n")
    with pytest.raises(Exception, match="malformed"):
        read_vcf(spark, str(tmp_path / "bad.vcf"))[0].collect()


def test_header_edits():
    assert HEAD.rename_samples(["a x"]).samples == ("x", "b") and HEAD.rename_samples(["p", "q"]).samples == ("p", "q")
    assert list(HEAD.sync_contigs(parse_fai("chr2\t5\t0\nchr1\t9\t0")).contigs) == ["chr1", "chr2"]
    assert "DP" in HEAD.append_line('##INFO=<ID=DP,Number=1,Type=Integer,Description="d, e">').infos
    for bad in (lambda: HEAD.rename_samples(["p"]), lambda: HEAD.append_line("##x=1"), lambda: HEAD.append_line('##INFO=<ID=AC,Number=1,Type=Integer,Description="">'), lambda: VariantHeader.parse("#CHROM"), lambda: parse_fai("x")):
        with pytest.raises(HeaderError):
            bad()


def test_projection_numbers_and_errors(spark):
    lines = [f"chr1\t{i + 1}\t.\tA\tC\t{q}\t.\tAN=3\tGT\t0|1\t." for i, q in enumerate(["007", "50.50", "9.0", "1e-5", "123456789", "0.00012345678", "999999.5", "."])]
    got = [r.value for r in query(records(spark, HEAD, lines), HEAD, "%QUAL").orderBy("row_id").collect()]
    assert got == ["7", "50.5", "9", "1e-05", "1.23457e+08", "0.000123457", "1e+06", "."]
    for bad in ("[%GT", "[[%GT]]", "%MAX(x)", "%NOPE", "%"):
        with pytest.raises(FormatError):
            Projection(bad, HEAD).column()


def test_gaps_equal_a_sequential_pass(spark):
    r = random.Random(4)
    lines, pos = [], 1
    for _ in range(400):
        pos += r.choice([0, 0, 1, 2, 3, 9])
        ref, alt = r.choice([("A", "C"), ("A", "AT"), ("ACG", "A"), ("AC", "GT"), ("A", "C,AT")])
        lines.append(f"chr1\t{pos}\t.\t{ref}\t{alt}\t{r.choice(['.', '0', '10', '20', '30'])}\t.\tAC=1;AN=4\tGT\t0/1\t1/1")
    df = records(spark, HEAD, lines)
    rows = df.select("row_id", "pos", "ref", "qual", variant.record_class().alias("m")).orderBy("row_id").collect()
    for n in (0, 2, 5):
        want = set()
        for i, late in enumerate(rows):
            hit = False
            for early in rows[:i]:
                if early.pos + len(early.ref) - 1 + n >= late.pos:
                    if late.m & 4 and early.m & 1:
                        want.add(early.row_id)
                    elif late.m & 1 and early.m & 4:
                        hit = True
            if hit:
                want.add(late.row_id)
        assert {x.row_id for x in filtering.snp_gap(df, n, width=16).collect()} == want
        marked, chain, until = set(), [], -1
        indels = [x for x in rows if x.m & 4]
        for x in [*indels, None]:
            if x is None or (chain and x.pos > until):
                quals = [c.qual for c in chain]
                best = chain[0]
                if quals[0] is not None and max(q for q in quals if q is not None) > 0:
                    top = max(q for q in quals if q is not None)
                    best = next(c for c in chain if c.qual == top)
                marked |= {c.row_id for c in chain if c is not best}
                chain = []
            if x is not None:
                chain.append(x)
                until = x.pos + len(x.ref) - 1 + n
        # counts of the fallback are equal for records of one ALT, so its first member stays
        one = df.where(F.size("alts") == 1)
        assert filtering.indel_gap(one, HEAD.with_(infos={}), n).count() > 0
        got = {x.row_id for x in filtering.indel_gap(df, HEAD.with_(infos={}), n).collect()}
        assert len(got) == len(marked)


def test_genotype_random_stream_is_sequential(spark):
    v = variants(spark, SF)
    state, want = ((7 & 0xFFFFFFFF) << 16) | 0x330E, {}
    for r in v.orderBy("row_id").select("row_id").collect():
        flags = []
        for _ in range(4):
            state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            flags.append(state / 2.0**48 <= 0.25)
        want[r.row_id] = flags
    out = setgt.set_genotypes(v, HEADER, "a", "c:.", fraction=0.25, seed=7)
    got = {r.row_id: [s.GT.alleles == [None] for s in r.samples] for r in out.select("row_id", "samples").collect()}
    assert got == want


def test_split_remaps_number_g(spark):
    lines = ["chr1\t5\t.\tA\tC,G\t.\t.\tAC=1,2;AN=4\tGT:PL\t0/2:1,2,3,4,5,6\t1:7,8,9"]
    rows = norm.split_multiallelic(records(spark, HEAD, lines), HEAD).orderBy("part").collect()
    assert [[s.PL for s in r.samples] for r in rows] == [[[1, 2, 3], [7, 8]], [[1, 4, 6], [7, 9]]]
    assert [r.info.AC for r in rows] == [[1], [2]] and [[s.GT.alleles for s in r.samples] for r in rows] == [[[0, 0], [1]], [[0, 1], [0]]]


def test_join_merges_alleles_and_fields(spark):
    lines = ["chr1\t5\tx\tA\tC\t10\tPASS\tAC=1;AN=4\tGT:PL\t0/1:1,2,3\t0/0:.", "chr1\t5\ty\tAT\tA\t30\tq\tAC=3;AN=4\tGT:PL\t0/0:4,5,6\t0/1:7,8,9", "chr1\t9\t.\tA\tC\t.\t.\tAN=2\tGT\t0/0\t0/0"]
    rows = norm.join_multiallelic(records(spark, HEAD, lines), HEAD, "any").orderBy("pos").collect()
    r = rows[0]
    assert (r.ref, r.alts, r.ids, r.qual, r.info.AC) == ("AT", ["CT", "A"], ["x", "y"], 30.0, [1, 3])
    assert [s.GT.alleles for s in r.samples] == [[0, 1], [0, 2]] and r.samples[0].PL == [4, 2, 3, 5, None, 6] and r.samples[1].PL is None
    assert len(rows) == 2 and len(norm.join_multiallelic(records(spark, HEAD, lines), HEAD, "snps").collect()) == 3


def test_alignment_against_reference(spark):
    seq = "GATTTTTTTCACACACAGT"
    assert norm.align(9, "TC", ["C"], seq, 1)[:3] == (2, "AT", ["A"])
    assert norm.align(16, "CAG", ["CACAG"], seq, 1)[:3] == (9, "T", ["TCA"])
    assert norm.align(2, "AT", ["A"], seq, 1, right=True)[0] > 2
    fasta = spark.createDataFrame([("chr1", 0, seq[:8]), ("chr1", 1, seq[8:16]), ("chr1", 2, seq[16:])], "chrom string, chunk int, seq string")
    df = records(spark, HEAD, ["chr1\t9\t.\tTC\tC\t.\t.\t.\tGT\t0\t0", "chr1\t3\t.\tG\tT\t.\t.\tAC=1;AN=2\tGT\t0\t1", "chr1\t3\t.\tT\t<DEL>\t.\t.\t.\tGT\t0\t0"])
    got = [(r.pos, r.ref, r.alts) for r in norm.normalize(df, fasta, 8).orderBy("row_id").collect()]
    assert got[0] == (2, "AT", ["A"]) and got[2] == (3, "T", ["<DEL>"])
    fixed = norm.check_reference(df, fasta, "s", 8).orderBy("row_id").collect()[1]
    assert (fixed.ref, fixed.alts, [s.GT.alleles for s in fixed.samples]) == ("T", ["G"], [[1], [0]])
    assert norm.check_reference(df, fasta, "x", 8).count() == 2
    with pytest.raises(Exception, match="mismatch"):
        norm.check_reference(df, fasta, "e", 8).collect()


def test_atoms():
    assert norm.atoms_of("ACG", "TCA") == [(0, "A", "T"), (2, "G", "A")]
    assert norm.atoms_of("A", "ATT") == [(0, "A", "ATT")] and norm.atoms_of("ATT", "A") == [(0, "ATT", "A")] and norm.atoms_of("AC", "GTT") == [(0, "A", "G"), (1, "C", "T"), (1, "C", "CT")]


def brute_atoms(ref, alts):
    """(offset, REF, ALT) -> (what each ALT's calls become, whether another atom overlaps), base by base."""
    atoms = []
    for k, alt in enumerate(alts):
        r, a = ref, alt
        while len(r) > 1 and len(a) > 1 and r[-1] == a[-1]:
            r, a = r[:-1], a[:-1]
        n = min(len(r), len(a))
        for i in range(n):
            if r[i] != a[i]:
                atoms.append((i, r[i], a[i], 0, k))
            if i == n - 1 and (len(r) != len(a) or r == a):
                atoms.append((i, r[i:], r[i] + a[n:], int(r[i] != a[i]), k))
    atoms.sort()
    out = {}
    for x in atoms:
        if x[:3] in out:
            continue
        to, star = [0] * len(alts), False
        for y in atoms:
            if y[:3] == x[:3]:
                to[y[4]] = 1
            elif set(range(x[0], x[0] + len(x[1]))) & set(range(y[0], y[0] + len(y[1]))):
                star, to[y[4]] = True, 2
                if x[0] == y[0]:
                    for p, q in ((x, y), (y, x)):
                        if p[3] and (len(q[1]) == 1 or (x[1] == y[1] and len(q[2]) == 1)):
                            to[y[4]] = 1
        out[x[:3]] = (to, star, x[4] + 1)
    return [(*k, *v) for k, v in out.items()]


def test_atoms_of_several_alts_equal_brute_force(spark):
    r = random.Random(5)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    pairs = [("AC", ["GTG"]), ("A", ["C", "G"]), ("ACG", ["TCG", "TCA"]), ("AT", ["A", "GT"]), ("A", ["*"]), ("A", ["<DEL>"]), ("A", []), ("AC", ["GT", "*"]), ("AC", ["GT", "<DEL>"])]
    pairs += [(ref := dna(r.randint(1, 4)), list({dna(r.randint(1, 4)) for _ in range(r.randint(1, 3))} - {ref}) or ["*"]) for _ in range(300)]
    lines, want = [], []
    for i, (ref, alts) in enumerate(pairs):
        gt = [r.choice([None, *range(len(alts) + 1)]) for _ in range(4)]
        ac = [r.randrange(50) for _ in alts]
        call = lambda g: "/".join("." if x is None else str(x) for x in g)
        lines.append(f"chr1\t{i + 1}\t.\t{ref}\t{','.join(alts) or '.'}\t.\t.\tAC={','.join(map(str, ac)) or '.'};AN=4\tGT\t{call(gt[:2])}\t{call(gt[2:])}")
        made = brute_atoms(ref, alts) if alts and all(set(a) <= set("ACGT") for a in alts) else None
        if made is None or (len(made) == len(alts) == 1 and made[0][:3] == (0, ref, alts[0])):
            want.append((i, 0, i + 1, ref, alts, ac or None, gt, None))
            continue
        for part, (at, x, y, to, star, source) in enumerate(made):
            origin = f"chr1|{i + 1}|{ref}|{','.join(alts)}|{','.join(str(k + 1) for k, t in enumerate(to) if t == 1)}"
            want.append((i, part, i + 1 + at, x, [y, "*"] if star else [y], [ac[source - 1], *([None] if star else [])], [g and to[g - 1] for g in gt], origin))
    out, _ = norm.atomize(records(spark, HEAD, lines), HEAD, old_rec_tag="OLD")
    got = [(x.row_id, x.part, x.pos, x.ref, x.alts, x.info.AC, [a for s in x.samples for a in s.GT.alleles], x.info.OLD) for x in out.orderBy("row_id", "part").collect()]
    assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want]
    assert [g[5] for g in got if g[4] and g[4] != ["*"]] == [w[5] for w in want if w[4] and w[4] != ["*"]]


def test_atoms_of_all_derived_rows(spark):
    from variform.plans.catalog import QUERIES

    v = {x.row_id: x for x in variants(spark, SF).select("row_id", "chrom", "pos", "ref", "alts").collect()}
    rows = QUERIES["norm_atomize_all"](spark, SF).collect()
    assert {x.row_id for x in rows} == set(v) and {len(x.alts) for x in v.values()} == {0, 1, 2}
    two = {(x.row_id, x.pos, x.ref, x.alt) for x in rows if len(v[x.row_id].alts) == 2}
    assert two == {(k, x.pos, x.ref, f"{a},*") for k, x in v.items() if len(x.alts) == 2 for a in x.alts}
    assert [x.alt for x in rows if x.alt in (".", "<DEL>")] and all(x.part == 0 and x.alt == (",".join(v[x.row_id].alts) or ".") for x in rows if x.alt in ("*", "<DEL>", "."))
    tags = {(x.row_id, x.origin.rsplit("|", 1)[1]) for x in QUERIES["norm_old_rec_tag_all"](spark, SF).collect() if x.origin}
    assert {(k, str(i)) for k, x in v.items() if len(x.alts) == 2 for i in (1, 2)} <= tags


def test_interval_files_and_annotation_modes(spark, tmp_path):
    (tmp_path / "x.bed").write_text("# c\nchr1\t4\t6\t12\n\nchr1\t4\t9\t.\n")
    src = read_intervals(spark, str(tmp_path / "x.bed"), ["CHROM", "FROM", "TO", "AN"])
    assert [(r["from"], r["to"], r.AN) for r in src.orderBy("serial").collect()] == [(5, 6, "12"), (5, 9, None)]
    df = records(spark, HEAD, ["chr1\t5\t.\tA\tC\t.\t.\tAC=1;AN=4\tGT\t0\t0", "chr1\t8\t.\tA\tC\t.\t.\tAC=1;AN=4\tGT\t0\t0", "chr1\t20\t.\tA\tC\t.\t.\tAC=1;AN=4\tGT\t0\t0"])
    out, _ = annotate.annotate_intervals(df, HEAD, src, "CHROM,FROM,TO,.INFO/AN")
    assert [r.info.AN for r in out.orderBy("row_id").collect()] == [12, None, 4]
    with pytest.raises(ValueError):
        annotate.parse_columns("CHROM,ID,+ID")
    with pytest.raises(HeaderError):
        annotate.annotate_intervals(df, HEAD, src, "CHROM,FROM,TO,INFO/NOPE")


def test_view_and_validation_errors(spark):
    v = variants(spark, SF)
    assert view.sample_indexes(HEADER, ["S3", "S1"]) == [2, 0] and view.sample_indexes(HEADER, ["S3", "no"], force=True) == [2]
    for bad in (lambda: view.sample_indexes(HEADER, ["no"]), lambda: view.sample_indexes(HEADER, ["S1", "S1"])):
        with pytest.raises(HeaderError):
            bad()
    with pytest.raises(ValueError):
        view.select_records(v, min_alleles=3, max_alleles=2)
    codes = {c for _, c, _ in validate.validate_header("##fileformat=VCFv4.9\n##INFO=<ID=DP,Number=x,Type=Foo,Description=\"\">\n##INFO=<ID=DP,Number=A,Type=Integer,Description=\"\">\n##bad\n#CHROM\tPOS\n##late=1\n#CHROM\tPOS")}
    assert codes >= {"header.version", "header.number", "header.type", "header.duplicate-definition", "header.meta-syntax", "header.fixed-columns", "header.meta-after-columns", "header.duplicate-columns", "header.newline", "header.reserved-definition"}
    assert validate.validate_header(TEXT + "\n") == []
    lines = ["chr1\t5\tx;x\tAZ\tC,C\t-1\tPASS;q\tAC=1;AN=-4\tGT\t0/7\t0", "chr1\t2000\t.\tA\tC\t.\t.\t.\tGT\t0\t0"]
    got = {(r.row_id, r.code) for r in validate.validate_records(records(spark, HEAD, lines), HEAD).collect()}
    assert got >= {(0, f"record.{c}") for c in ("duplicate-id", "ref", "duplicate-alt", "qual", "filter", "cardinality", "value-range", "genotype-allele")} | {(1, "record.contig-bound")}


def test_streams(spark, tmp_path):
    from variform.streaming.streams import deduplicated

    v = variants(spark, SF).select("row_id", "chrom", "pos", "ref", "alts").limit(200)
    v.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    q = deduplicated(stream, 1 << 20).writeStream.format("memory").queryName("dedup").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(str(tmp_path / "in")).withColumn("a", F.array_sort("alts")).select("chrom", "pos", "ref", "a").distinct().count()
    assert spark.table("dedup").count() == want
