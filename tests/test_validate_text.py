"""Rules of VCF text, one case a rule."""

import pytest

from variform.operators.validate_text import LineRules, Schema, header_problems, separators, split_values, validate_vcf

COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def header(*meta, version="VCFv4.3", columns=COLUMNS, reference=True):
    lines = [f"##fileformat={version}", *(["##reference=file.fa"] if reference else []), *meta, columns]
    return "".join(line + "\n" for line in lines)


@pytest.mark.parametrize("text, codes", [
    (header(), []), ("", ["header.missing", "header.reference"]), (header(reference=False), ["header.reference"]), (header(version="VCFv4.9"), ["header.version"]), ("##x=1\n" + header(), ["header.fileformat"]),
    (header()[:-1], ["header.newline"]), (header() + "##late=1\n", ["header.meta-after-columns"]), (header("##nothing"), ["header.meta-syntax"]), (header("##=x"), ["header.meta-key"]), (header("##x="), ["header.meta-value"]),
    (header("##assembly=http://a.org/x"), []), (header("##assembly=<ftp://u@host:21/x>"), []), (header("##assembly=nowhere"), ["header.url"]), (header("##pedigreeDB=http://a..b/"), ["header.url"]),
    (header() + COLUMNS + "\n", ["header.duplicate-columns"]), (header("#what"), ["header.columns"]), ("##fileformat=VCFv4.3\n##reference=x\nchr1\t1\n", ["header.record-before-columns", "header.missing-columns"]),
    (header(columns="#CHROM\tPOS"), ["header.fixed-columns"]), (header(columns=COLUMNS + "\tFORMAT"), ["header.samples"]), (header(columns=COLUMNS + "\tX\ta"), ["header.format-column"]), (header(columns=COLUMNS + "\tFORMAT\ta\t\ta"), ["header.sample-name", "header.duplicate-sample"]),
    (header('##INFO=<ID=X,Number=1,Type=Integer,Description="a, \\"b\\"">'), []), (header('##INFO=<ID=X,Type=Integer,Number=1,Description="">'), ["header.field-order"]), (header("##INFO=<ID=X,Number=1,Type=Integer,Description=bare>"), ["header.description"]),
    (header('##INFO=<ID=X,Number=P,Type=Integer,Description="">'), ["header.number"]), (header('##FORMAT=<ID=X,Number=P,Type=Integer,Description="">', version="VCFv4.4"), []), (header('##FORMAT=<ID=X,Number=LA,Type=Integer,Description="">', version="VCFv4.4"), ["header.number"]),
    (header('##FORMAT=<ID=X,Number=1,Type=Flag,Description="">'), ["header.type"]), (header('##INFO=<ID=X,Number=0,Type=Integer,Description="">'), ["header.number-zero"]), (header('##INFO=<ID=AC,Number=1,Type=Integer,Description="">'), ["header.reserved-definition"]),
    (header('##INFO=<ID=9X,Number=1,Type=Integer,Description="">'), ["header.id"]), (header('##INFO=<Number=1,Type=Integer,Description="">'), ["header.required-field"]), (header("##INFO=x"), ["header.map-syntax"]), (header("##INFO=<ID=X,Number,Type=Integer>"), ["header.map-field"]), (header("##INFO=<ID=X,ID=Y>"), ["header.map-field"]),
    (header('##FILTER=<ID=q,Description="">', '##FILTER=<ID=q,Description="">'), ["header.duplicate-definition"]), (header("##FILTER=<ID=q>"), ["header.field-order"]), (header("##FILTER=<ID=q>", version="VCFv4.4"), []),
    (header('##ALT=<ID=DEL:ME,Description="">'), []), (header('##ALT=<ID=FOO,Description="">'), ["header.alt-id"]), (header('##ALT=<Description="",ID=DEL>'), ["header.alt-fields"]), (header('##ALT=<ID=DEL,Number=1,Type=String,Description="">', version="VCFv4.2"), []),
    (header("##contig=<ID=1,length=0>"), ["header.contig-length"]), (header("##contig=<ID=1>", "##contig=<ID=1,length=5>"), []), (header("##contig=<ID=*>"), ["header.id"]), (header("##contig=<length=5>"), ["header.required-field"]),
    (header("##META=<ID=A,Number=.,Type=String,Values=[x, y]>"), []), (header("##META=<ID=A,Number=1,Type=Integer,Values=x>"), ["header.meta-number", "header.meta-type", "header.meta-values"]), (header("##META=<ID=A>"), ["header.meta-fields"]),
    (header("##PEDIGREE=<ID=c,Father=f>"), []), (header("##PEDIGREE=<Father=f>"), ["header.required-field"]), (header("##PEDIGREE=<Father=f>", version="VCFv4.2"), []), (header("##PEDIGREE=<ID=c,Father=a b>"), ["header.pedigree-value"]),
    (header("##SAMPLE=<ID=s>"), []), (header("##SAMPLE=<ID=s s>"), ["header.sample-id"]), (header('##SAMPLE=<ID=s,Genomes="g",Mixture=m,Description="d">', version="VCFv4.2"), ["header.sample-value"]), (header("##SAMPLE=<ID=s>", version="VCFv4.1"), ["header.required-field"] * 3),
    (header("##x=\ufffd"), ["header.utf8"]),
])
def test_header_rules(text, codes):
    assert [c for _, c, _ in header_problems(text)[0]] == codes


def schema(minor=3, samples=("a",)):
    return Schema(minor, {"X": ("2", "Integer"), "C": ("1", "Character"), "T": (".", "String")}, {"Z": ("LA", "Integer"), "LAA": (".", "Integer"), "M": ("M", "String")}, {"1": 1000}, list(samples))


def line(chrom="1", pos="5", ids=".", ref="A", alt="C", qual=".", filters=".", info=".", form="GT", call="0/1"):
    return "\t".join([chrom, pos, ids, ref, alt, qual, filters, info, form, call])


@pytest.mark.parametrize("text, minor, codes", [
    (line(), 3, []), (line() + "\tx", 3, ["columns"]), (line(chrom="*x"), 3, ["chrom"]), (line(chrom="<x>"), 3, []), (line(pos="x"), 3, ["pos"]), (line(pos="2147483648"), 3, ["pos"]), (line(pos="0"), 3, []),
    (line(ids="a;a"), 3, ["duplicate-id"]), (line(ids="a;;a"), 3, ["id"]), (line(ref="R"), 3, ["ref"]), (line(alt="C,<,C"), 3, ["alt", "duplicate-alt"]), (line(alt="<DEL>,<DEL>"), 3, ["duplicate-alt"]),
    (line(alt="A[1:5[,]<x>:7]A,.A,A.,*"), 3, []), (line(alt="A[1:0["), 3, ["alt"]), (line(alt="[1:5]A"), 3, ["alt"]), (line(qual="-1"), 3, ["qual"]), (line(qual="nan"), 3, []), (line(qual="1e3"), 3, []), (line(qual="x"), 3, ["qual"]),
    (line(filters="q;q"), 3, ["duplicate-filter"]), (line(filters="0"), 3, ["filter"]), (line(filters="PASS"), 3, []), (line(info=""), 3, ["info"]), (line(info="DP=1;DP=2"), 3, ["duplicate-info"]), (line(info="9x=1"), 3, ["info-key"]), (line(info="9x=1"), 2, []), (line(info="a%41=1"), 3, ["info-key"]), (line(info="a%41=1"), 4, []), (line(info="1000G"), 3, []),
    (line(info="DB=2"), 3, ["flag-value"]), (line(info="DB=1;DB2"), 3, []), (line(info="DP"), 3, ["missing-value"]), (line(info="DP="), 3, ["empty-value"]), (line(info="T="), 5, []), (line(info="X=1"), 3, ["cardinality"]), (line(info="AC=1,2"), 3, ["cardinality"]), (line(info="AF=2"), 3, ["value-range"]), (line(info="DP=-1"), 3, ["value-range"]),
    (line(info="DP=x"), 3, ["value-type"]), (line(info="X=1,-2147483648"), 3, ["value-type"]), (line(info="AF=inf"), 3, ["value-range"]), (line(info="C=ab"), 3, ["value-type"]), (line(info="T=a b"), 3, ["value-type"]), (line(info='T="a,b",c'), 3, []), (line(info="CIGAR=3M1X"), 3, []), (line(info="CIGAR=0M"), 3, ["cigar"]), (line(info="END=1001"), 3, ["contig-bound"]), (line(pos="1002", info="DP=1"), 3, ["contig-bound"]), (line(pos="1002"), 3, []), (line(pos="1001", info="DP=1"), 3, []),
    (line(form="."), 3, ["format"]), (line(form="GT:DP:DP", call="0/1:1:1"), 3, ["format-key"]), (line(form="DP:GT", call="1:0/1"), 3, ["gt-order"]), (line(call=""), 3, ["sample"]), (line(call=""), 5, []), (line(call="0/1:7"), 3, ["sample-width"]), (line(call="."), 3, []),
    (line(call="0//1"), 3, ["genotype"]), (line(call="|0/1"), 3, []), (line(call="0/1/"), 3, ["genotype"]), (line(call="0/1/"), 4, []), (line(call="0/2"), 3, ["genotype-allele"]), (line(form="GT:PL", call="0:1,2"), 3, []), (line(form="GT:PL", call="0/1:1,2"), 3, ["cardinality"]), (line(form="GT:PL", call="0/0/1:1,2,3,4"), 3, []), (line(form="PL", call="1,2,3"), 3, []),
    (line(alt="C,G", form="GT:LAA:Z", call="0/1:2:5"), 5, []), (line(alt="C,G", form="GT:LAA:Z", call="0/1:2,2:5,6"), 5, ["local-allele"]), (line(form="GT:LAA", call="0/1:3"), 5, ["local-allele"]), (line(alt="C,G", form="GT:LAA:Z", call="0/1:1,2:5"), 5, ["cardinality"]),
    (line(alt="<DEL>", info="SVCLAIM=D"), 4, ["svlen-required"]), (line(alt="<DEL>", info="SVLEN=5"), 4, ["svclaim-required"]), (line(alt="<INV>", info="SVLEN=5;SVCLAIM=D"), 4, ["svclaim"]), (line(alt="<INV>,C", info="SVLEN=5,.;SVCLAIM=J"), 4, ["svclaim-cardinality"]), (line(alt="<FOO:x>"), 4, ["symbolic-alt"]), (line(alt="A[1:5[", info="SVCLAIM=J"), 4, []), (line(alt="C", info="SVCLAIM=J"), 4, ["svclaim"]),
    (line(alt="<CNV:TR>", info="SVLEN=5"), 4, ["repeat-unit-required"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RUL=3"), 4, ["repeat-unit-redundant", "repeat-unit-length"]), (line(alt="<CNV:TR>", info="SVLEN=5;RN=2;RUS=CA"), 4, ["repeat-cardinality"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;CIRB=0,0"), 4, ["repeat-interval-parent"]),
    (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RB=4;CIRB=0"), 4, ["repeat-interval-cardinality"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RB=.;CIRB=0,1"), 4, ["repeat-interval-missing"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RB=4;CIRB=1,2"), 4, ["confidence-interval"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RUC=3;RB=9"), 4, ["repeat-bases"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RUC=3;RB=6"), 4, []),
    (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RUB=2"), 4, ["rub-parent"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RUC=1.5;RUB=2"), 4, ["rub-ruc", "rub-cardinality"]), (line(alt="<CNV:TR>", info="SVLEN=5;RUS=CA;RUC=2;RUB=2,2"), 4, []),
    (line(info="CICN=0"), 4, ["cicn-cardinality"]), (line(info="CICN=1,2"), 4, ["confidence-interval"]), (line(info="CICN=-1,."), 4, []), (line(form="GT:CICN", call="0/1:0,0"), 4, ["format-cicn-parent"]), (line(form="GT:CN:CICN", call="0/1:2:0"), 4, ["format-cicn-cardinality"]),
    (line(alt="<DEL>,<DUP>", info="SVLEN=5,6;SVCLAIM=D,D", form="GT:CN", call="0/1:2"), 4, ["copy-number-svlen"]), (line(form="GT:PSL", call="0/1:x,y"), 4, ["psl-unphased"] * 2), (line(form="GT:PSL", call="0|1:x,y"), 4, []), (line(form="GT:PSL:PSO", call="0|1:.,y:1,2"), 4, ["phase-value"]), (line(info="T=\ufffd"), 3, ["utf8"]),
])
def test_line_rules(text, minor, codes):
    assert [c.removeprefix("record.") for c, _ in LineRules(schema(minor)).problems(text)] == codes


def test_evidence_and_parts():
    rules = LineRules(schema(samples=()), require_evidence=True)
    bare = "1\t5\t.\tA\tC\t.\t.\t"
    assert [[c for c, _ in rules.problems(bare + info)] for info in (".", "AF=0.5", "AC=1", "AC=1;AN=2")] == [["record.evidence"], [], ["record.evidence"], []]
    assert split_values('a,"b,c",d') == ["a", '"b,c"', "d"] and split_values("a,,") == ["a", "", ""]
    assert [separators(x) for x in ("0/1", "0|1", "/0|1", "0", "0|1/2", "0/1/")] == ["//", "||", "/|", "|", "/|/", "//"]


def test_whole_file(spark, tmp_path):
    text = header('##INFO=<ID=AC,Number=1,Type=Integer,Description="">', "##contig=<ID=1,length=1000>", reference=False)
    body = ["1\t10\t.\tA\tC\t-1\t.\t.", "1\t5\t.\tAG\tCG\t.\t.\t.", "1\t5\t.\tA\tC\t.\t.\t.", "2\t5\t.\tA\tC\t.\t.\t.", "1\t2000\t.\tA\tC\t.\t.\tDP=1", "2\t6\t.\tA\tC\t.\t.\t."]
    (tmp_path / "x.vcf").write_text(text + "\n".join(body))
    found, report = validate_vcf(spark, str(tmp_path / "x.vcf"), max_diagnostics=3)
    got = sorted((r.severity, r.code) for r in found.collect())
    want = [("error", c) for c in ("header.reserved-definition", "input.newline", "record.qual", "record.position-order", "record.duplicate-variant", "record.contig-order", "record.contig-order", "record.contig-bound")]
    assert got == sorted([*want, ("warning", "header.reference")])
    r = report.first()
    assert (r.format, r.version, r.records, r.errors, r.warnings, len(r.diagnostics), r.truncated) == ("vcf", "4.3", 6, 8, 1, 3, True)
