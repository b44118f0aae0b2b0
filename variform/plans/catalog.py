"""The registered queries of the library and, beside each, independent DuckDB SQL for it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.functions import variant
from variform.functions.expression import compile_truth
from variform.functions.projection import Projection, query
from variform.operators import annotate, filtering, norm, regions, setgt, validate, validate_text, view
from variform.sources import vcf
from variform.sources.derived import HEADER, SITES_SQL, intervals, variants
from variform.sources.header import Field

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- SQL of the same rows

_ALLELE = "CASE WHEN (k + {a}) % 7 = 6 THEN NULL ELSE CAST((k + {b}) % (n + 1) AS INTEGER) END"


def _allele(i: int, h: int) -> str:
    return _ALLELE.format(a=3 * i + 5 * h, b=i + h)


BASE = f"""
WITH s AS ({SITES_SQL.format(orders='orders')}),
v0 AS (SELECT k, chrom, CAST(pos AS INTEGER) AS pos, ref, alt, CASE WHEN alt = '.' THEN [] ELSE string_split(alt, ',') END AS alts,
    CAST(qual AS FLOAT) AS qual, filter, dp, CASE WHEN k % 3 = 0 THEN 'rs' || k ELSE '.' END AS id,
    CASE WHEN alt = '.' THEN 0 ELSE len(string_split(alt, ',')) END AS n FROM s),
v AS (SELECT *, k AS row_id, CAST(k % 5 AS INTEGER) AS contig_idx,
    [{', '.join(f'[{_allele(i, 0)}, {_allele(i, 1)}]' for i in range(4))}] AS gt,
    [{', '.join(f'(k + {i}) % 3 = 0' for i in range(4))}] AS ph,
    [{', '.join(f'CASE WHEN (k + {i}) % 9 <> 0 THEN CAST((3 * k + {7 * i}) % 50 AS INTEGER) END' for i in range(4))}] AS sdp,
    [{', '.join(f'list_transform(range(0, n + 1), lambda a: CAST((k + {i} + 3 * a) % 40 AS INTEGER))' for i in range(4))}] AS ad,
    list_transform(range(1, greatest(n, 1) + 1), lambda a: CAST(((k + a) % 10) / 10.0 AS FLOAT)) AS af,
    CASE WHEN n = 0 THEN 64 WHEN alt = '*' THEN 32 WHEN alt = '<DEL>' THEN 8 WHEN length(ref) = 1 AND length(alts[1]) = 1 THEN 1
         WHEN length(ref) <> length(alts[1]) THEN 4 ELSE 2 END AS cls
    FROM v0),
c AS (SELECT *, list_filter(flatten(gt), lambda a: a IS NOT NULL) AS called FROM v)
"""


def q(sql: str | None = None):
    """Register a query under the function's name, with the SQL that follows BASE."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (BASE if "$BASE" not in sql else "") + sql.replace("$BASE", BASE)
        return f

    return register


def _list(c: Column, sep: str = ",") -> Column:
    return F.coalesce(F.when(F.size(c) > 0, F.array_join(c, sep)), F.lit("."))


def _gts(samples: Column | str = "samples") -> Column:
    return F.array_join(F.transform(samples, lambda s: variant.gt_text(s["GT"])), " ")


def _alleles(samples: Column | str = "samples") -> Column:
    """Calls as 0,1 without separators' phase."""
    return F.array_join(F.transform(samples, lambda s: F.array_join(F.transform(s["GT"]["alleles"], lambda a: F.coalesce(a.cast("string"), F.lit("."))), ",")), " ")


#: SQL text of calls as _alleles prints them, for a list of lists.
def _sql_alleles(gt: str) -> str:
    return f"array_to_string(list_transform({gt}, lambda g: array_to_string(list_transform(g, lambda a: coalesce(CAST(a AS VARCHAR), '.')), ',')), ' ')"


def _keep(df: DataFrame) -> DataFrame:
    return df.select("row_id", "chrom", "pos", "ref", _list(F.col("alts")).alias("alt"))


_KEEP = "row_id, chrom, pos, ref, alt"


def _filtered(expression: str, exclude: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, _ = filtering.filter_variants(variants(spark, sf_dir), HEADER, **({"exclude": expression} if exclude else {"include": expression}))
        return _keep(out)

    return run


def _expression(name: str, expression: str, where: str, exclude: bool = False) -> None:
    QUERIES[name] = _filtered(expression, exclude)
    ORACLE[name] = f"{BASE} SELECT {_KEEP} FROM c WHERE {where}"


# ---------------------------------------------------------------- expressions and hard filters

@q("SELECT chrom, count(*) AS records, sum(CAST(qual AS DOUBLE)) AS qual_sum FROM c WHERE dp >= 20 AND qual >= 30 GROUP BY chrom")
def filter_hard(spark, sf_dir):
    out, _ = filtering.filter_variants(variants(spark, sf_dir), HEADER, include="INFO/DP >= 20 && QUAL >= 30")
    return out.groupBy("chrom").agg(F.count("*").alias("records"), F.sum(F.col("qual").cast("double")).alias("qual_sum"))


@q("SELECT row_id, chrom, contig_idx, pos, id, ref, alt, qual, filter, dp, array_to_string(list_transform(af, lambda a: CAST(CAST(round(a * 10) AS INTEGER) AS VARCHAR)), ',') AS af10, k % 4 = 0 AS db FROM v")
def sites_scan(spark, sf_dir):
    v = variants(spark, sf_dir)
    af = F.array_join(F.transform("info.AF", lambda a: F.round(a * 10).cast("int").cast("string")), ",")
    return v.select("row_id", "chrom", "contig_idx", "pos", _list(F.col("ids"), ";").alias("id"), "ref", _list(F.col("alts")).alias("alt"), "qual", _list(F.col("filters"), ";").alias("filter"), F.col("info.DP").alias("dp"), af.alias("af10"), F.col("info.DB").alias("db"))


_SDP = "len(list_filter(sdp, lambda d: {})) > 0"
_expression("filter_exclude", "QUAL < 30 || INFO/DP < 10", "NOT (coalesce(qual < 30, false) OR dp < 10)", exclude=True)
_expression("expr_arith", "INFO/DP * 2 + 1 > QUAL - 5 & POS % 3 = 1", "coalesce(dp * 2 + 1 > CAST(qual AS DOUBLE) - 5, false) AND pos % 3 = 1")
_expression("expr_division", "QUAL / INFO/DP > 2", "coalesce(CASE WHEN dp = 0 THEN qual > 0 ELSE CAST(CAST(qual AS DOUBLE) / dp AS FLOAT) > 2 END, false)")
_expression("expr_missing", 'QUAL = "." | ID != "."', "qual IS NULL OR id <> '.'")
_expression("expr_any_pair", "INFO/AF > 0.45", "len(list_filter(af, lambda a: a > CAST(0.45 AS FLOAT))) > 0")
_expression("expr_f32_compare", "INFO/AF = 0.1 || INFO/AF = 0.7", "len(list_filter(af, lambda a: a = CAST(0.1 AS FLOAT) OR a = CAST(0.7 AS FLOAT))) > 0")
_expression("expr_logic_and", "FMT/DP > 30 & FMT/DP < 40", _SDP.format("d > 30 AND d < 40"))
_expression("expr_logic_and_and", "FMT/DP > 40 && FMT/DP < 10", f"{_SDP.format('d > 40')} AND {_SDP.format('d < 10')}")
_expression("expr_logic_or", "FMT/DP > 47 | QUAL > 90", f"{_SDP.format('d > 47')} OR coalesce(qual > 90, false)")
_expression("expr_regex", 'FILTER ~ "^q" & REF !~ "a/i" | ALT ~ "del"/i', "(regexp_matches(filter, '^q') AND NOT regexp_matches(ref, 'a/i')) OR regexp_matches(alt, '(?i)del')")
_expression("expr_subscript", "FMT/AD[0:1] > 20 && FMT/AD[2-3:0] < 30", "coalesce(ad[1][2] > 20, false) AND (ad[3][1] < 30 OR ad[4][1] < 30)")
_expression("expr_subscript_info", "INFO/AF[1] >= 0.5", "CASE WHEN len(af) = 1 THEN af[1] >= 0.5 ELSE af[2] >= 0.5 END")
_expression("expr_subscript_gt", "FMT/AD[:GT] > 38", "len(list_filter([1, 2, 3, 4], lambda i: len(list_filter(gt[i], lambda a: a IS NOT NULL AND ad[i][a + 1] > 38)) > 0)) > 0")
_COMPLETE = "len(list_filter(g, lambda a: a IS NULL)) = 0"
_expression("expr_gt_het", 'GT = "het"', f"len(list_filter(gt, lambda g: {_COMPLETE} AND g[1] <> g[2])) > 0")
_expression("expr_gt_hom", 'GT = "RR" || GT[1-] = "Aa"', f"len(list_filter(gt, lambda g: {_COMPLETE} AND g[1] = 0 AND g[2] = 0)) > 0 OR len(list_filter(gt[2:4], lambda g: {_COMPLETE} AND g[1] <> g[2] AND g[1] > 0 AND g[2] > 0)) > 0")
_expression("expr_gt_mis", 'GT[0,2] = "mis"', "len(list_filter(gt[1], lambda a: a IS NULL)) > 0 OR len(list_filter(gt[3], lambda a: a IS NULL)) > 0")
_expression("expr_gt_spelling", 'GT = "0|1"', "len(list_filter([1, 2, 3, 4], lambda i: gt[i][1] = 0 AND gt[i][2] = 1 AND ph[i])) > 0")
_expression("expr_calc_ac_af_maf", "AC > 3 && AN >= 6 && MAF > 0.3", "len(list_filter(range(1, n + 1), lambda i: len(list_filter(called, lambda a: a = i)) > 3)) > 0 AND len(called) >= 6 AND CAST((SELECT CASE WHEN min(m) = len(called) THEN 0 ELSE min(m) END FROM (SELECT unnest(list_filter(list_transform(range(0, n + 1), lambda i: len(list_filter(called, lambda a: a = i))), lambda x: x > 0)) AS m)) / len(called) AS FLOAT) > CAST(0.3 AS FLOAT)")
_expression("expr_n_missing", "N_MISSING = 2 | F_MISSING = 0.75", "len(list_filter(gt, lambda g: len(list_filter(g, lambda a: a IS NULL)) > 0)) IN (2, 3)")
_expression("expr_ilen", "ILEN < 0 || ILEN > 1", "alt NOT LIKE '<%' AND n > 0 AND (length(alts[1]) - length(ref) < 0 OR length(alts[1]) - length(ref) > 1)")
_expression("expr_type", 'TYPE = "SNP" || TYPE = "MNP"', "cls IN (1, 2)")
_VALUES = "list_filter(sdp, lambda d: d IS NOT NULL)"
_expression("fn_site_reduce", "MAX(FMT/DP) > 40 && MIN(FMT/DP) < 5 && AVG(FMT/DP) > 15", f"coalesce(list_max(sdp) > 40 AND list_min(sdp) < 5 AND CAST(list_avg({_VALUES}) AS FLOAT) > 15, false)")
_expression("fn_median_stdev", "MEDIAN(FMT/DP) > 20 && STDEV(FMT/DP) < 12 && SUM(FMT/DP) > 50", f"coalesce(CAST(list_median({_VALUES}) AS FLOAT) > 20 AND CAST(list_stddev_pop({_VALUES}) AS FLOAT) < 12 AND list_sum({_VALUES}) > 50, false)")
_expression("fn_sample_reduce", "SMPL_MAX(FMT/AD) > 38 & SMPL_MIN(FMT/AD) < 36", "len(list_filter(ad, lambda d: list_max(d) > 38 AND list_min(d) < 36)) > 0")
_expression("fn_phred_abs_strlen", "PHRED(INFO/AF) > 6 && STRLEN(REF) > 1 | ABS(QUAL - 50) > 45", "(len(list_filter(af, lambda a: CASE WHEN a = 0 THEN true ELSE CAST(-4.34294481903 * ln(CAST(a AS DOUBLE)) AS FLOAT) > 6 END)) > 0 AND length(ref) > 1) OR coalesce(abs(qual - 50) > 45, false)")
_expression("fn_npass_fpass", "N_PASS(FMT/DP > 20) >= 3 && F_PASS(GT = \"het\") >= 0.5", f"len(list_filter(sdp, lambda d: d > 20)) >= 3 AND len(list_filter(gt, lambda g: {_COMPLETE} AND g[1] <> g[2])) >= 2")
_expression("fn_count", "COUNT(FMT/DP) < 4 && COUNT(GT=\"het\") > 1", f"len({_VALUES}) < 4 AND len(list_filter(gt, lambda g: {_COMPLETE} AND g[1] <> g[2])) > 1")


#: Two-sided binomial test of the depths of the two called alleles of sample i, null where there is none.
_DEPTHS = "list_transform(gt[i], lambda a: CASE WHEN a IS NOT NULL THEN ad[i][a + 1] END)"
_BINOM_OF = "CASE WHEN {d}[1] IS NULL OR {d}[2] IS NULL OR {d}[1] + {d}[2] = 0 THEN NULL WHEN {d}[1] = {d}[2] THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({d}[1], {d}[2]) + 1), lambda j: exp(lgamma({d}[1] + {d}[2] + 1) - lgamma(j + 1) - lgamma({d}[1] + {d}[2] - j + 1) - ({d}[1] + {d}[2]) * ln(2.0))))) END"
_BINOM = f"list_transform([1, 2, 3, 4], lambda i: {_BINOM_OF.format(d=_DEPTHS)})"

_expression("fn_sample_count", "SMPL_COUNT(FMT/AD) > 2 & FMT/DP > 30", "len(list_filter([1, 2, 3, 4], lambda i: len(ad[i]) > 2 AND coalesce(sdp[i] > 30, false))) > 0")
_expression("expr_and_many", "FMT/DP > 3 & FMT/DP < 45 & FMT/DP != 20 & FMT/AD[*:0] > 2 & FMT/AD[*:0] < 38 & GT != \"mis\" & FMT/DP >= 5 & FMT/DP <= 44", f"len(list_filter([1, 2, 3, 4], lambda i: sdp[i] BETWEEN 5 AND 44 AND sdp[i] <> 20 AND ad[i][1] > 2 AND ad[i][1] < 38 AND len(list_filter(gt[i], lambda a: a IS NULL)) = 0)) > 0")


@q("SELECT row_id FROM c WHERE coalesce(sdp[2] > 40, false) OR coalesce(sdp[4] > 40, false)")
def expr_sample_file(spark, sf_dir):
    """Samples named in a file select the values that count."""
    t = compile_truth("FMT/DP[@chosen] > 40", HEADER, lambda name: ["S2", "S4"])
    return variants(spark, sf_dir).where(t.site).select("row_id")


@q(f"SELECT row_id, array_to_string(list_transform({_BINOM}, lambda p: CASE WHEN coalesce(CAST(p AS FLOAT) < CAST(0.05 AS FLOAT), false) THEN 'true' ELSE 'false' END), ',') AS passes FROM v WHERE len(list_filter({_BINOM}, lambda p: CAST(p AS FLOAT) < CAST(0.05 AS FLOAT))) > 0")
def fn_binom(spark, sf_dir):
    v = variants(spark, sf_dir)
    t = compile_truth("BINOM(FMT/AD) < 0.05", HEADER)
    v = variant.bound(v, *variant.mentioned(v, t.passes)).select("row_id", t.passes.alias("passes"))
    v = variant.bound(v, "passes").where(F.exists("passes", lambda p: p))
    return v.select("row_id", F.array_join(F.col("passes").cast("array<string>"), ",").alias("passes"))


_FISHER_AT = "exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma({x} + 1) - lgamma(a + b - {x} + 1) - lgamma(a + c - {x} + 1) - lgamma(d - a + {x} + 1))"


@q(f"""SELECT row_id, chrom, pos, ref, alt FROM (SELECT *, {_FISHER_AT.format(x='a')} AS own FROM (
        SELECT *, CAST((k * 3) % 23 AS INTEGER) AS a, CAST((k * 5) % 23 AS INTEGER) AS b, CAST((k * 7) % 23 AS INTEGER) AS c, CAST((k * 11) % 23 AS INTEGER) AS d FROM v))
    WHERE a + b + c + d > 0 AND CAST(least(1.0, list_sum(list_filter(list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda x: {_FISHER_AT.format(x='x')}), lambda p: p <= own * (1 + 1e-7)))) AS FLOAT) < CAST(0.01 AS FLOAT)""")
def fn_fisher(spark, sf_dir):
    header = HEADER.with_(infos=HEADER.infos | {"DP4": Field("DP4", "4", "Integer", "")})
    v = variants(spark, sf_dir)
    four = F.array(*[((F.col("row_id") * m) % 23).cast("int") for m in (3, 5, 7, 11)])
    return _keep(v.withColumn("info", F.col("info").withField("DP4", four)).where(compile_truth("FISHER(INFO/DP4) < 0.01", header).site))


@q("SELECT row_id, len(list_filter(called, lambda a: a > 0)) AS n_alt, id IN ('rs3', 'rs6', 'rs300') AS listed FROM c WHERE id IN ('rs3', 'rs6', 'rs300') OR chrom = 'chr2'")
def expr_value_set(spark, sf_dir):
    listed = compile_truth("ID = @known", HEADER, lambda name: ["rs3", "rs6", "rs300"])
    chosen = compile_truth('ID = @known || CHROM = "chr2"', HEADER, lambda name: ["rs3", "rs6", "rs300"])
    n = F.size(F.filter(variant.called(), lambda a: a > 0)).cast("long")
    return variants(spark, sf_dir).where(chosen.site).select("row_id", n.alias("n_alt"), listed.site.alias("listed"))


# ---------------------------------------------------------------- projections

_QUAL = "CASE WHEN qual IS NULL THEN '.' ELSE CAST(CAST(qual AS INTEGER) AS VARCHAR) END"


@q(f"SELECT row_id, concat(chrom, chr(9), pos, chr(9), id, chr(9), ref, chr(9), alt, chr(9), {_QUAL}, chr(9), filter, chr(9), dp) AS value FROM v")
def query_site(spark, sf_dir):
    return query(variants(spark, sf_dir), HEADER, r"%CHROM\t%POS\t%ID\t%REF\t%ALT\t%QUAL\t%FILTER\t%INFO/DP\n")


@q("SELECT row_id, concat(pos, ' ', array_to_string(list_transform([1, 2, 3, 4], lambda i: concat('S', i, '=', coalesce(CAST(sdp[i] AS VARCHAR), '.'), ':', array_to_string(ad[i], ','), ';')), '')) AS value FROM v")
def query_samples(spark, sf_dir):
    return query(variants(spark, sf_dir), HEADER, "%POS [%SAMPLE=%DP:%AD;]")


_BASE_OF = "coalesce(CASE WHEN a = 0 THEN ref ELSE alts[a] END, '.')"


@q(f"SELECT row_id, array_to_string(list_transform([1, 3], lambda i: replace(array_to_string(list_transform(gt[i], lambda a: {_BASE_OF}), '/'), '/', CASE WHEN ph[i] THEN '|' ELSE '/' END)), ' ') AS value FROM v")
def query_tgt(spark, sf_dir):
    v = query(variants(spark, sf_dir), HEADER, "[%TGT ]", ["S1", "S3"])
    return v.select("row_id", F.rtrim("value").alias("value"))


@q("""SELECT row_id, CASE WHEN length(x) = 1 AND length(y) = 1 AND x <> '.' AND y <> '.' AND x <> '*' AND y <> '*' THEN
        CASE least(x, y) || greatest(x, y) WHEN 'AA' THEN 'A' WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CC' THEN 'C'
             WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' WHEN 'GG' THEN 'G' WHEN 'GT' THEN 'K' WHEN 'TT' THEN 'T' END
        ELSE x || CASE WHEN p THEN '|' ELSE '/' END || y END AS value
      FROM (SELECT row_id, ph[2] AS p, coalesce(CASE WHEN gt[2][1] = 0 THEN ref ELSE alts[gt[2][1]] END, '.') AS x,
            coalesce(CASE WHEN gt[2][2] = 0 THEN ref ELSE alts[gt[2][2]] END, '.') AS y FROM v)""")
def query_iupac(spark, sf_dir):
    return query(variants(spark, sf_dir), HEADER, "[%IUPACGT]", ["S2"])


@q("SELECT row_id, concat(pos - 1, ' ', pos + length(ref) - 1, ' ', pos + length(ref) - 2, ' ', coalesce(alts[1], '.'), ' ', CASE cls WHEN 1 THEN 'SNP' WHEN 2 THEN 'MNP' WHEN 4 THEN 'INDEL' WHEN 8 THEN 'OTHER' WHEN 32 THEN 'OVERLAP' ELSE 'REF' END) AS value FROM v")
def query_end_type(spark, sf_dir):
    return query(variants(spark, sf_dir), HEADER, "%POS0 %END %END0 %FIRST_ALT %TYPE")


@q("SELECT row_id, concat(coalesce(alts[2], '.'), ' ', coalesce(CAST(ad[1][2] AS VARCHAR), '.'), ' ', CASE WHEN k % 4 = 0 THEN '1' ELSE '.' END, ' ', printf('%g', CAST(CASE WHEN len(af) = 1 THEN af[1] ELSE af[2] END AS DOUBLE))) AS value FROM v")
def query_subscript(spark, sf_dir):
    return query(variants(spark, sf_dir), HEADER, "%ALT{1} [%AD{1}] %DB %INFO/AF{1}", ["S1"])


_AF_TEXT = "array_to_string(list_transform(af, lambda a: printf('%g', CAST(a AS DOUBLE))), ',')"
_INFO_TEXT = f"concat('DP=', dp, ';AF=', {_AF_TEXT}, CASE WHEN k % 4 = 0 THEN ';DB' ELSE '' END)"
_SAMPLES_TEXT = "array_to_string(list_transform([1, 2, 3, 4], lambda i: concat(replace(array_to_string(list_transform(gt[i], lambda a: coalesce(CAST(a AS VARCHAR), '.')), '/'), '/', CASE WHEN ph[i] THEN '|' ELSE '/' END), ':', coalesce(CAST(sdp[i] AS VARCHAR), '.'), ':', array_to_string(ad[i], ','))), chr(9))"


@q(f"SELECT row_id, concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), id, ref, alt, {_QUAL}, filter, {_INFO_TEXT}, 'GT:DP:AD', {_SAMPLES_TEXT}) AS value FROM v")
def query_line(spark, sf_dir):
    return query(variants(spark, sf_dir), HEADER, "%LINE")


@q(f"SELECT row_id, concat(pos, ' ', 'GT:DP:AD', chr(9), {_SAMPLES_TEXT}) AS value FROM v")
def query_format(spark, sf_dir):
    return query(variants(spark, sf_dir), HEADER, "%POS %FORMAT")


@q("$BASE SELECT '#[1]CHROM [2]S1:DP [3]S4:DP' AS indexed, '#CHROM S1:DP S4:DP' AS plain")
def query_header(spark, sf_dir):
    p = Projection("%CHROM [%DP ]", HEADER, ["S1", "S4"])
    return spark.range(1).select(F.lit(p.header_row().strip()).alias("indexed"), F.lit(p.header_row(False).strip()).alias("plain"))


# ---------------------------------------------------------------- view

@q(f"SELECT {_KEEP} FROM v WHERE filter IN ('q10', '.')")
def view_filter(spark, sf_dir):
    return _keep(view.select_records(variants(spark, sf_dir), filters=["q10", "."]))


@q("SELECT row_id, id <> '.' AS known FROM v WHERE (id <> '.' AND cls = 4) OR (id = '.' AND cls = 2)")
def view_known_novel(spark, sf_dir):
    v = variants(spark, sf_dir)
    known = view.select_records(v, known=True, types="indels").select("row_id", F.lit(True).alias("known"))
    return known.unionByName(view.select_records(v, known=False, types="mnps").select("row_id", F.lit(False).alias("known")))


@q(f"SELECT {_KEEP} FROM v WHERE cls IN (2, 4, 64)")
def view_types(spark, sf_dir):
    return _keep(view.select_records(variants(spark, sf_dir), types="indels,mnps,ref", exclude_types="snps"))


@q(f"SELECT {_KEEP} FROM v WHERE n + 1 BETWEEN 3 AND 4")
def view_alleles(spark, sf_dir):
    return _keep(view.select_records(variants(spark, sf_dir), min_alleles=3, max_alleles=4))


_REGIONS = ["chr1:100-5,000", "chr3:700-", "chr5"]


def _region(mode: str):
    def run(spark, sf_dir):
        return _keep(regions.select_regions(variants(spark, sf_dir), [regions.parse_region(r) for r in _REGIONS], mode))

    return run


_IN = "((chrom = 'chr1' AND {s} <= 5000 AND {e} >= 100) OR (chrom = 'chr3' AND {e} >= 700) OR chrom = 'chr5')"
_OFFSET = "list_min(list_transform(alts, lambda x: list_max(list_filter(range(0, least(length(ref), length(x)) + 1), lambda p: left(ref, p) = left(x, p)))))"
for _mode, _s, _e, _more in (("pos", "pos", "pos", "true"), ("record", "pos", "pos + length(ref) - 1", "true"), ("variant", f"(pos + {_OFFSET})", "(pos + length(ref) - 1)", f"n > 0 AND pos + {_OFFSET} <= pos + length(ref) - 1")):
    QUERIES[f"view_region_{_mode}"] = _region(_mode)
    ORACLE[f"view_region_{_mode}"] = f"{BASE} SELECT {_KEEP} FROM v WHERE {_more} AND {_IN.format(s=_s, e=_e)}"


@q(f"SELECT {_KEEP} FROM v WHERE NOT {_IN.format(s='pos', e='pos')}")
def view_target_exclude(spark, sf_dir):
    return _keep(regions.select_regions(variants(spark, sf_dir), [regions.parse_region(r) for r in _REGIONS], "pos", negate=True))


@q(f"""SELECT row_id, {_sql_alleles('[gt[3], gt[1]]')} AS gts, CASE WHEN n = 0 THEN '.' ELSE array_to_string(list_transform(range(1, n + 1), lambda i: len(list_filter(c2, lambda a: a = i))), ',') END AS ac, CAST(len(c2) AS INTEGER) AS an
    FROM (SELECT *, list_filter(flatten([gt[3], gt[1]]), lambda a: a IS NOT NULL) AS c2 FROM v)""")
def view_samples_acan(spark, sf_dir):
    out, _ = view.select_samples(variants(spark, sf_dir), HEADER, ["S3", "S1"])
    return out.select("row_id", _alleles().alias("gts"), F.coalesce(F.array_join("info.AC", ","), F.lit(".")).alias("ac"), F.col("info.AN").alias("an"))


@q("SELECT row_id, CAST(len(list_filter(flatten([gt[2], gt[4]]), lambda a: a IS NOT NULL)) AS INTEGER) AS an, false AS has_samples FROM v")
def view_drop_gt(spark, sf_dir):
    out, _ = view.select_samples(variants(spark, sf_dir), HEADER, ["S1", "S3"], exclude=True, drop_genotypes=True)
    return out.select("row_id", F.col("info.AN").alias("an"), F.lit("samples" in out.columns).alias("has_samples"))


@q(f"SELECT {_KEEP} FROM v ORDER BY row_id LIMIT 25")
def head_n(spark, sf_dir):
    return _keep(view.head(variants(spark, sf_dir), 25))


@q("SELECT line, value FROM (SELECT row_number() OVER (ORDER BY row_id) + 2 AS line, concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), id, ref, alt) AS value FROM v) WHERE line <= 12 UNION ALL SELECT * FROM (VALUES (1, '##fileformat=VCFv4.3'), (2, '##FILTER=<ID=PASS,Description=\"All filters passed\">'))")
def head_lines(spark, sf_dir):
    out = view.head_lines(variants(spark, sf_dir), HEADER, records=10, header_lines=2)
    return out.select("line", F.when(F.col("line") > 2, F.substring_index("value", "\t", 5)).otherwise(F.col("value")).alias("value"))


# ---------------------------------------------------------------- soft filters, masks, genotypes, gaps

_PASSES = "(dp >= 20 AND coalesce(qual >= 30, false))"


def _soft(mode: str):
    def run(spark, sf_dir):
        out, _ = filtering.filter_variants(variants(spark, sf_dir), HEADER, include="INFO/DP >= 20 && QUAL >= 30", soft="LOW", mode=mode)
        return out.select("row_id", _list(F.col("filters"), ";").alias("filter"))

    return run


for _name, _mode, _pass, _fail in (
    ("replace", "", "CASE WHEN filter = '.' THEN 'PASS' ELSE filter END", "'LOW'"),
    ("add", "+", "CASE WHEN filter = '.' THEN 'PASS' ELSE filter END", "CASE WHEN filter IN ('PASS', '.') THEN 'LOW' ELSE filter || ';LOW' END"),
    ("reset", "x", "'PASS'", "'LOW'"),
    ("addreset", "+x", "'PASS'", "CASE WHEN filter IN ('PASS', '.') THEN 'LOW' ELSE filter || ';LOW' END"),
):
    QUERIES[f"filter_soft_{_name}"] = _soft(_mode)
    ORACLE[f"filter_soft_{_name}"] = f"{BASE} SELECT row_id, CASE WHEN {_PASSES} THEN {_pass} ELSE {_fail} END AS filter FROM v"


@q("SELECT row_id, CASE WHEN chrom = 'chr2' AND pos <= 9000 AND pos + length(ref) - 1 >= 500 OR NOT coalesce(qual > 10, false) THEN 'MASK' WHEN filter = '.' THEN 'PASS' ELSE filter END AS filter FROM v")
def filter_mask(spark, sf_dir):
    out, _ = filtering.filter_variants(variants(spark, sf_dir), HEADER, include="QUAL > 10", soft="MASK", mask=[("chr2", 500, 9000)])
    return out.select("row_id", _list(F.col("filters"), ";").alias("filter"))


def _failed_gt(to: str):
    def run(spark, sf_dir):
        out, _ = filtering.filter_variants(variants(spark, sf_dir), HEADER, include="FMT/DP >= 10", set_genotypes=to)
        return out.select("row_id", _gts().alias("gts"))

    return run


_GT_TEXT = "replace(array_to_string(list_transform(gt[i], lambda a: coalesce(CAST(a AS VARCHAR), '.')), '/'), '/', CASE WHEN ph[i] THEN '|' ELSE '/' END)"
for _name, _to in (("missing", "./."), ("ref", "0/0")):
    QUERIES[f"filter_set_gt_{_name}"] = _failed_gt(_to[0])
    ORACLE[f"filter_set_gt_{_name}"] = f"{BASE} SELECT row_id, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN coalesce(sdp[i] >= 10, false) THEN {_GT_TEXT} ELSE '{_to}' END), ' ') AS gts FROM v"


@q("""SELECT s.row_id FROM v s WHERE s.cls = 1 AND (
    EXISTS (SELECT 1 FROM v l WHERE l.chrom = s.chrom AND l.cls = 4 AND (l.pos, l.row_id) > (s.pos, s.row_id) AND s.pos + length(s.ref) - 1 + 3 >= l.pos)
    OR EXISTS (SELECT 1 FROM v e WHERE e.chrom = s.chrom AND e.cls = 4 AND (e.pos, e.row_id) < (s.pos, s.row_id) AND e.pos + length(e.ref) - 1 + 3 >= s.pos))""")
def filter_snpgap(spark, sf_dir):
    return filtering.snp_gap(variants(spark, sf_dir), 3)


@q("""SELECT row_id FROM (
    SELECT *, row_number() OVER (PARTITION BY chrom, chain ORDER BY CASE WHEN by_qual THEN 0 ELSE 1 END, CASE WHEN by_qual THEN -coalesce(qual, -1) ELSE -ac END, pos, row_id) AS r
    FROM (SELECT *, first_value(qual) OVER w IS NOT NULL AND max(qual) OVER (PARTITION BY chrom, chain) > 0 AS by_qual
          FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY pos, row_id) AS chain
                FROM (SELECT row_id, chrom, pos, qual, len(list_filter(called, lambda a: a = 1)) AS ac,
                             CASE WHEN pos > lag(pos + length(ref) - 1 + 2) OVER (PARTITION BY chrom ORDER BY pos, row_id) THEN 1 ELSE 0 END AS o FROM c WHERE cls = 4))
          WINDOW w AS (PARTITION BY chrom, chain ORDER BY pos, row_id)))
    WHERE r > 1""")
def filter_indelgap(spark, sf_dir):
    return filtering.indel_gap(variants(spark, sf_dir), HEADER, 2)


QUERIES["filter_gap_soft"] = lambda spark, sf_dir: filtering.gap_filter(variants(spark, sf_dir), HEADER, snp=3, indel=2, soft=True)[0].select("row_id", _list(F.col("filters"), ";").alias("filter"))
_MARKED = [ORACLE[f"filter_{n}"].removeprefix(BASE) for n in ("snpgap", "indelgap")]
ORACLE["filter_gap_soft"] = f"""{BASE}, sg AS ({_MARKED[0]}), ig AS ({_MARKED[1]}),
    m AS (SELECT row_id, filter, row_id IN (SELECT row_id FROM sg) AS s, row_id IN (SELECT row_id FROM ig) AS i FROM v)
    SELECT row_id, CASE WHEN NOT s AND NOT i THEN filter ELSE concat_ws(';', CASE WHEN filter NOT IN ('PASS', '.') THEN filter END, CASE WHEN s THEN 'SnpGap' END, CASE WHEN i THEN 'IndelGap' END) END AS filter FROM m"""

# ---------------------------------------------------------------- annotation

_INTERVALS = "i AS (SELECT p_partkey AS serial, 'chr' || (1 + p_partkey % 5) AS ic, 1 + (p_partkey * 613) % 20011 AS a, 1 + (p_partkey * 613) % 20011 + p_size AS b, p_brand AS name FROM part)"
_WITH_I = f"$BASE, {_INTERVALS}, m AS (SELECT v.row_id, i.* FROM v JOIN i ON ic = chrom AND a <= pos + length(ref) - 1 AND b >= pos)"


@q(f"{_WITH_I} SELECT row_id, min(serial) AS serial, arg_min(name, serial) AS name FROM m GROUP BY row_id")
def ann_interval_first(spark, sf_dir):
    return annotate.match_intervals(variants(spark, sf_dir), HEADER, intervals(spark, sf_dir)).select("row_id", "serial", "name")


@q(f"{_WITH_I} SELECT row_id, string_agg(CAST(serial AS VARCHAR), ',' ORDER BY serial) AS serials FROM m GROUP BY row_id")
def ann_interval_all(spark, sf_dir):
    header = HEADER.with_(infos=HEADER.infos | {"SER": Field("SER", ".", "Integer", "")})
    v = variants(spark, sf_dir).withColumn("info", F.col("info").withField("SER", F.lit(None).cast("array<int>")))
    src = intervals(spark, sf_dir).withColumn("SER", F.col("serial").cast("string"))
    out, _ = annotate.annotate_intervals(v, header, src, "CHROM,FROM,TO,=INFO/SER")
    return out.where("info.SER IS NOT NULL").select("row_id", F.array_join("info.SER", ",").alias("serials"))


@q(f"$BASE, {_INTERVALS} SELECT row_id, count(*) AS n FROM v JOIN i ON ic = chrom AND a <= pos + length(ref) - 1 AND b >= pos WHERE (least(pos + length(ref) - 1, b) - greatest(pos, a) + 1.0) / (b - a + 1) >= 0.1 AND (least(pos + length(ref) - 1, b) - greatest(pos, a) + 1.0) / length(ref) >= 0.5 GROUP BY row_id")
def ann_min_overlap(spark, sf_dir):
    return annotate.count_intervals(variants(spark, sf_dir), HEADER, intervals(spark, sf_dir), (0.1, 0.5))


def _pairs(logic: str):
    """Even records against odd ones, paired at their coordinates."""

    def run(spark, sf_dir):
        v = variants(spark, sf_dir)
        kind = F.col("row_id") % 10 < 5
        return annotate.match_variants(v.where(kind), HEADER, v.where(~kind), logic).select("row_id", F.col("s_row_id").alias("source"))

    return run


_SAME = "s.ref = t.ref AND ((s.n = 0 AND t.n = 0) OR len(list_intersect(s.alts, t.alts)) > 0)"
_EXACT = "s.ref = t.ref AND list_sort(s.alts) = list_sort(t.alts)"
_REFPAIR = "(s.cls = 64 AND t.cls {b}) OR (t.cls = 64 AND s.cls {b})"
for _logic, _cond in (
    ("all", "true"), ("some", _SAME), ("exact", _EXACT), ("id", f"{_EXACT} AND s.id = t.id"),
    ("snps", f"({_SAME}) OR {_REFPAIR.format(b='IN (1, 2)')}"), ("indels", f"({_SAME}) OR {_REFPAIR.format(b='= 4')}"),
    ("both", f"({_SAME}) OR (s.cls IN (1, 2) AND t.cls IN (1, 2)) OR (s.cls = 4 AND t.cls = 4) OR {_REFPAIR.format(b='IN (1, 2)')} OR {_REFPAIR.format(b='= 4')}"),
):
    QUERIES[f"ann_pair_{_logic}"] = _pairs(_logic)
    ORACLE[f"ann_pair_{_logic}"] = f"{BASE} SELECT t.row_id, min(s.row_id) AS source FROM v t JOIN v s ON s.chrom = t.chrom AND s.pos = t.pos AND t.k % 10 < 5 AND s.k % 10 >= 5 WHERE {_cond} GROUP BY t.row_id"


def _marked(present: bool):
    def run(spark, sf_dir):
        v = variants(spark, sf_dir)
        out, _ = annotate.mark_sites(v, HEADER, annotate.match_intervals(v, HEADER, intervals(spark, sf_dir)), "HIT", present)
        return out.select("row_id", F.col("info.HIT").alias("hit"))

    return run


for _name, _present in (("present", True), ("absent", False)):
    QUERIES[f"ann_mark_{_name}"] = _marked(_present)
    ORACLE[f"ann_mark_{_name}"] = f"{_WITH_I.replace('$BASE', BASE)} SELECT row_id, row_id {'' if _present else 'NOT '}IN (SELECT row_id FROM m) AS hit FROM v"


def _written(mode: str):
    """INFO/DP from an interval's size class, under a write mode; DP is missing in every seventh record."""

    def run(spark, sf_dir):
        v = variants(spark, sf_dir)
        v = v.withColumn("info", F.col("info").withField("DP", F.when(F.col("row_id") % 7 != 0, F.col("info.DP"))))
        src = intervals(spark, sf_dir).withColumn("DP", F.when(F.col("serial") % 3 != 0, (F.col("serial") % 100).cast("string")))
        out, _ = annotate.annotate_intervals(v, HEADER, src, f"CHROM,FROM,TO,{mode}INFO/DP")
        return out.select("row_id", F.col("info.DP").alias("dp"))

    return run


for _name, _mode, _sql in (
    ("replace", "", "coalesce(src, own)"), ("missing", ".", "CASE WHEN hit THEN src ELSE own END"), ("add", "+", "coalesce(own, src)"),
    ("addmissing", ".+", "coalesce(own, src)"), ("existing", "-", "CASE WHEN own IS NOT NULL THEN coalesce(src, own) END"),
):
    QUERIES[f"ann_write_{_name}"] = _written(_mode)
    ORACLE[f"ann_write_{_name}"] = f"""{_WITH_I.replace('$BASE', BASE)}, f AS (SELECT row_id, min(serial) AS s FROM m GROUP BY row_id),
        j AS (SELECT v.row_id, CASE WHEN k % 7 <> 0 THEN dp END AS own, f.row_id IS NOT NULL AS hit, CASE WHEN s % 3 <> 0 THEN CAST(s % 100 AS INTEGER) END AS src FROM v LEFT JOIN f USING (row_id))
        SELECT row_id, {_sql} AS dp FROM j"""


@q("SELECT row_id, CASE WHEN id = '.' THEN chrom || '_' || pos || '_' || ref ELSE id END AS id FROM v")
def ann_set_id(spark, sf_dir):
    return annotate.set_id(variants(spark, sf_dir), HEADER, "+%CHROM\\_%POS\\_%REF").select("row_id", _list(F.col("ids"), ";").alias("id"))


@q("SELECT row_id, '.' AS id, 'AF,DB' AS infos, 'GT,AD' AS formats, CASE WHEN filter = 'q10' THEN '.' ELSE filter END AS filter FROM v")
def ann_remove(spark, sf_dir):
    out, header = annotate.remove(variants(spark, sf_dir), HEADER, "ID,^INFO/AF,^INFO/DB,FORMAT/DP,FILTER/q10")
    infos, formats = (",".join(f.name for f in t) for t in (out.schema["info"].dataType, out.schema["samples"].dataType.elementType))
    return out.select("row_id", _list(F.col("ids")).alias("id"), F.lit(infos).alias("infos"), F.lit(formats).alias("formats"), _list(F.col("filters")).alias("filter"))


@q("SELECT row_id, CASE chrom WHEN 'chr1' THEN '1' WHEN 'chr2' THEN '2' ELSE chrom END AS chrom, dp AS depth, CASE filter WHEN 'q10' THEN 'lowq' ELSE filter END AS filter FROM v")
def ann_rename(spark, sf_dir):
    out, _ = annotate.rename(variants(spark, sf_dir), HEADER, {"INFO/DP": "DEPTH", "FILTER/q10": "lowq"}, {"chr1": "1", "chr2": "2"})
    return out.select("row_id", "chrom", F.col("info.DEPTH").alias("depth"), _list(F.col("filters")).alias("filter"))


@q("SELECT t.row_id, array_to_string([coalesce(CAST(coalesce(s.sdp[1], t.sdp[1]) AS VARCHAR), '.'), coalesce(CAST(t.sdp[2] AS VARCHAR), '.'), coalesce(CAST(coalesce(s.sdp[2], t.sdp[3]) AS VARCHAR), '.'), coalesce(CAST(t.sdp[4] AS VARCHAR), '.')], ' ') AS dps FROM v t LEFT JOIN (SELECT DISTINCT ON (chrom, pos) * FROM v WHERE k % 10 >= 5 ORDER BY chrom, pos, row_id) s ON s.chrom = t.chrom AND s.pos = t.pos WHERE t.k % 10 < 5")
def ann_format_samples(spark, sf_dir):
    v = variants(spark, sf_dir)
    kind = F.col("row_id") % 10 < 5
    source_header = HEADER.with_(samples=("S1", "S3", "X", "Y"))
    out, _ = annotate.annotate_variants(v.where(kind), HEADER, v.where(~kind), source_header, "FORMAT/DP", logic="all")
    dps = F.transform("samples", lambda s: F.coalesce(s["DP"].cast("string"), F.lit(".")))
    return out.select("row_id", F.array_join(dps, " ").alias("dps"))


_HALVES = "t AS (SELECT * FROM v WHERE k % 10 < 5), so AS (SELECT * FROM v WHERE k % 10 >= 5)"


@q(f"""$BASE, {_HALVES}, m AS (SELECT t.row_id, min(s.row_id) AS source FROM t JOIN so s ON s.chrom = t.chrom AND s.pos = t.pos WHERE {_SAME} GROUP BY t.row_id)
    SELECT t.row_id, array_to_string(CASE WHEN source IS NULL OR t.n = 0 THEN list_transform(t.af, lambda a: round(a, 1))
        ELSE list_transform(range(1, t.n + 1), lambda i: round(CASE WHEN list_contains(s.alts, t.alts[i]) THEN s.af[list_position(s.alts, t.alts[i])] ELSE t.af[i] END, 1)) END, ',') AS af
    FROM t LEFT JOIN m USING (row_id) LEFT JOIN so s ON s.row_id = source""")
def ann_allele_transfer(spark, sf_dir):
    v = variants(spark, sf_dir)
    kind = F.col("row_id") % 10 < 5
    out, _ = annotate.annotate_variants(v.where(kind), HEADER, v.where(~kind), HEADER, "INFO/AF,FORMAT/AD", logic="some")
    return out.select("row_id", F.array_join(F.transform("info.AF", lambda a: F.coalesce(a.cast("string"), F.lit("."))), ",").alias("af"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets and sources: the two records of each locus."""
    v = variants(spark, sf_dir)
    kind = F.col("row_id") % 10 < 5
    return v.where(kind), v.where(~kind)


def _tabular(sources: DataFrame, *extra: Column) -> DataFrame:
    at = F.col("pos")
    return sources.select(F.col("row_id").alias("serial"), "chrom", at.alias("from"), at.alias("to"), "ref", _list(F.col("alts")).alias("alt"), F.col("info.DP").cast("string").alias("DP"), *extra).withColumnsRenamed({"ref": "REF", "alt": "ALT"})


_EXTENDED = "(starts_with(t.ref, s.ref) OR starts_with(s.ref, t.ref)) AND ((s.n = 0 AND t.n = 0) OR len(list_intersect(list_transform(s.alts, lambda x: x || substr(t.ref, length(s.ref) + 1)), list_transform(t.alts, lambda x: x || substr(s.ref, length(t.ref) + 1)))) > 0)"


@q(f"""$BASE, {_HALVES}, m AS (SELECT t.row_id, arg_min(s.dp, s.row_id) AS d FROM t JOIN so s ON s.chrom = t.chrom AND s.pos = t.pos WHERE {_EXTENDED} GROUP BY t.row_id)
    SELECT t.row_id, coalesce(d, t.dp) AS dp FROM t LEFT JOIN m USING (row_id)""")
def ann_tab_alleles(spark, sf_dir):
    target, source = _halves(spark, sf_dir)
    out, _ = annotate.annotate_intervals(target, HEADER, _tabular(source), "CHROM,POS,REF,ALT,INFO/DP")
    return out.select("row_id", F.col("info.DP").alias("dp"))


@q(f"""$BASE, {_HALVES}, m AS (SELECT t.row_id, arg_min(s.dp, s.row_id) AS d FROM t JOIN so s ON s.chrom = t.chrom AND s.pos BETWEEN t.pos AND t.pos + length(t.ref) - 1 WHERE t.id = 'rs' || (s.k - 5) OR t.id = 'rs' || (s.k - 4) GROUP BY t.row_id)
    SELECT t.row_id, coalesce(d, t.dp) AS dp FROM t LEFT JOIN m USING (row_id)""")
def ann_tab_id(spark, sf_dir):
    target, source = _halves(spark, sf_dir)
    ids = F.concat(F.lit("rs"), (F.col("row_id") - 5).cast("string"), F.lit(";rs"), (F.col("row_id") - 4).cast("string"))
    out, _ = annotate.annotate_intervals(target, HEADER, _tabular(source, ids.alias("~ID")), "CHROM,POS,~ID,INFO/DP")
    return out.select("row_id", F.col("info.DP").alias("dp"))


#: Sources with their ALTs turned round; of each target genotype (a, b), the place among the source's.
_TURNED = "so AS (SELECT * REPLACE (list_reverse(alts) AS alts) FROM v WHERE k % 10 >= 5)"
_OWN = "CASE WHEN x = 0 THEN 0 ELSE nullif(list_position(s.alts, t.alts[x]), 0) END"
_GENOTYPES = "flatten(list_transform(range(0, t.n + 1), lambda b: list_transform(range(0, b + 1), lambda a: [a, b])))"
_PLACED = f"list_transform({_GENOTYPES}, lambda g: list_transform(g, lambda x: {_OWN}))"


@q(f"""$BASE, t AS (SELECT * FROM v WHERE k % 10 < 5), {_TURNED}, m AS (SELECT t.row_id, min(s.row_id) AS source FROM t JOIN so s ON s.chrom = t.chrom AND s.pos = t.pos WHERE {_SAME} GROUP BY t.row_id)
    SELECT t.row_id, CASE WHEN source IS NULL THEN '' ELSE array_to_string(list_transform([1, 2, 3, 4], lambda i: array_to_string(list_transform({_PLACED},
        lambda o: CASE WHEN o[1] IS NULL OR o[2] IS NULL THEN '.' ELSE CAST((s.k * 7 + i * 11 + 13 * (greatest(o[1], o[2]) * (greatest(o[1], o[2]) + 1) // 2 + least(o[1], o[2]))) % 97 AS VARCHAR) END), ',')), ' ') END AS pls
    FROM t LEFT JOIN m USING (row_id) LEFT JOIN so s ON s.row_id = source""")
def ann_number_g(spark, sf_dir):
    """FORMAT/PL (Number=G) of sources whose ALTs stand the other way round."""
    target, source = _halves(spark, sf_dir)
    size = ((F.size("alts") + 1) * (F.size("alts") + 2) / 2).cast("int")
    likely = lambda i: F.transform(F.sequence(F.lit(0), size - 1), lambda j: ((F.col("row_id") * 7 + (i + 1) * 11 + 13 * j) % 97).cast("int"))
    source = source.withColumn("alts", F.reverse("alts")).withColumn("samples", F.array(*[F.get("samples", F.lit(i)).withField("PL", likely(i)) for i in range(4)]))
    source_header = HEADER.with_(formats=HEADER.formats | {"PL": Field("PL", "G", "Integer", "")})
    target = target.withColumn("samples", F.transform("samples", lambda s: s.withField("PL", F.lit(None).cast("array<int>"))))
    out, _ = annotate.annotate_variants(target, source_header, source, source_header, "FORMAT/PL")
    one = lambda s: F.array_join(F.transform(s["PL"], lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
    return out.select("row_id", F.array_join(F.transform("samples", one), " ").alias("pls"))


@q(f"""$BASE, t AS (SELECT * FROM v WHERE k % 10 < 5), {_TURNED}, m AS (SELECT t.row_id, min(s.row_id) AS source FROM t JOIN so s ON s.chrom = t.chrom AND s.pos = t.pos WHERE {_EXACT} GROUP BY t.row_id)
    SELECT t.row_id, {_sql_alleles('CASE WHEN source IS NULL THEN t.gt ELSE list_transform(s.gt, lambda g: list_transform(g, lambda a: CASE WHEN a > 0 THEN list_position(t.alts, s.alts[a]) ELSE a END)) END')} AS gts
    FROM t LEFT JOIN m USING (row_id) LEFT JOIN so s ON s.row_id = source""")
def ann_gt_remap(spark, sf_dir):
    target, source = _halves(spark, sf_dir)
    out, _ = annotate.annotate_variants(target, HEADER, source.withColumn("alts", F.reverse("alts")), HEADER, "FORMAT/GT", logic="exact")
    return out.select("row_id", _alleles().alias("gts"))


# ---------------------------------------------------------------- genotype editing

def _set(target: str, new: str, **how):
    def run(spark, sf_dir):
        return setgt.set_genotypes(variants(spark, sf_dir), HEADER, target, new, **how).select("row_id", _gts().alias("gts"))

    return run


def _set_sql(chosen: str, new: str) -> str:
    return f"{BASE} SELECT row_id, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN {chosen} THEN {new} ELSE {_GT_TEXT} END), ' ') AS gts FROM c"


_N_NULL = "len(list_filter(gt[i], lambda a: a IS NULL))"
for _name, _target, _chosen, _how in (
    ("any_missing", ".", f"{_N_NULL} > 0", {}), ("partial", "./x", f"{_N_NULL} = 1", {}), ("complete", "./.", f"{_N_NULL} = 2", {}), ("all", "a", "true", {}),
    ("query", "q", "coalesce(sdp[i] < 10, false)", {"include": "FMT/DP < 10"}),
    ("query_exclude", "q", "i IN (1, 3) AND NOT coalesce(sdp[i] > 10, false)", {"exclude": "FMT/DP[0,2] > 10"}),
):
    QUERIES[f"setgt_{_name}"] = _set(_target, "0", **_how)
    ORACLE[f"setgt_{_name}"] = _set_sql(_chosen, "'0/0'")
_COUNTS = "list_transform(range(0, n + 1), lambda x: len(list_filter(called, lambda a: a = x)))"
for _name, _new, _sql in (
    ("missing", ".", "'./.'"), ("ref", "0", "'0/0'"), ("phased", "0p", "'0|0'"),
    ("phase", "p", "array_to_string(list_transform(gt[i], lambda a: coalesce(CAST(a AS VARCHAR), '.')), '|')"),
    ("unphase", "u", "array_to_string(list_transform(list_sort(list_transform(gt[i], lambda a: coalesce(a, -1))), lambda a: CASE WHEN a < 0 THEN '.' ELSE CAST(a AS VARCHAR) END), '/')"),
    ("invert", "i", "replace(array_to_string(list_transform([gt[i][2], gt[i][1]], lambda a: coalesce(CAST(a AS VARCHAR), '.')), '/'), '/', CASE WHEN ph[i] THEN '|' ELSE '/' END)"),
    ("custom", "c:0|1/2", "concat('0|', CASE WHEN n >= 1 THEN '1' ELSE '.' END, '/', CASE WHEN n >= 2 THEN '2' ELSE '.' END)"),
    ("depth", "X", "concat(list_position(ad[i], list_max(ad[i])) - 1, '/', list_position(ad[i], list_max(ad[i])) - 1)"),
):
    QUERIES[f"setgt_to_{_name}"] = _set("a", _new)
    ORACLE[f"setgt_to_{_name}"] = _set_sql("true", _sql)
_MAJOR = f"list_position({_COUNTS}, list_max({_COUNTS})) - 1"
QUERIES["setgt_to_major"] = _set("./x", "M")
ORACLE["setgt_to_major"] = _set_sql(f"{_N_NULL} = 1", f"concat({_MAJOR}, '/', {_MAJOR})")
QUERIES["setgt_binom"] = _set("b:AD<0.05", ".")
ORACLE["setgt_binom"] = _set_sql(f"gt[i][1] <> gt[i][2] AND coalesce(CAST({_BINOM_OF.format(d=_DEPTHS)} AS FLOAT) < CAST(0.05 AS FLOAT), false)", "'./.'")
QUERIES["setgt_random"] = _set("a", "0", fraction=0.25, seed=7)
# The generator's step is squared again and again; each draw's state is made of the steps of its number's binary digits.
ORACLE["setgt_random"] = "WITH RECURSIVE " + BASE.strip().removeprefix("WITH ") + f""",
    steps(b, m, c) AS (SELECT 0, CAST(25214903917 AS HUGEINT), CAST(11 AS HUGEINT)
        UNION ALL SELECT b + 1, (m * m) % 281474976710656, (c * m + c) % 281474976710656 FROM steps WHERE b < 32),
    numbered AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS r FROM v),
    draws(b, row_id, i, n, x) AS (
        SELECT 0, row_id, i, 4 * r + i, CAST(7 * 65536 + 13070 AS HUGEINT) FROM numbered, (SELECT unnest([1, 2, 3, 4]) AS i)
        UNION ALL SELECT d.b + 1, row_id, i, n, CASE WHEN (n >> d.b) & 1 = 1 THEN (x * m + c) % 281474976710656 ELSE x END FROM draws d JOIN steps USING (b) WHERE d.b < 32),
    hit AS (SELECT row_id, list(i) AS chosen FROM draws WHERE b = 32 AND x / 281474976710656.0 <= 0.25 GROUP BY row_id)
    SELECT row_id, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN list_contains(coalesce(chosen, []), i) THEN '0/0' ELSE {_GT_TEXT} END), ' ') AS gts
    FROM v LEFT JOIN hit USING (row_id)"""

_MINOR = "list_sort(list_transform(range(0, n + 1), lambda x: [-len(list_filter(called, lambda a: a = x)), x]))[2][2]"


@q(f"SELECT row_id, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN {_N_NULL} = 1 THEN concat({_MINOR}, '|', {_MINOR}) ELSE {_GT_TEXT} END), ' ') AS gts FROM c WHERE n >= 1")
def setgt_to_minor(spark, sf_dir):
    v = view.select_records(variants(spark, sf_dir), min_alleles=2)
    return setgt.set_genotypes(v, HEADER, "./x", "mp").select("row_id", _gts().alias("gts"))


@q(f"SELECT CAST(sum(CASE WHEN gt[i] <> [0, 0] OR {_N_NULL} > 0 OR ph[i] THEN 1 ELSE 0 END) AS BIGINT) AS genotypes, CAST(sum(len(list_filter(gt[i], lambda a: a IS NULL OR a <> 0))) AS BIGINT) AS alleles FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM v)")
def setgt_changes(spark, sf_dir):
    v = variants(spark, sf_dir)
    return setgt.changes(v, setgt.set_genotypes(v, HEADER, "a", "0"))


# ---------------------------------------------------------------- normalisation

_PARTS = "p AS (SELECT *, unnest(range(0, greatest(n, 1))) AS part FROM v)"


@q(f"$BASE, {_PARTS} SELECT row_id, CAST(part AS INTEGER) AS part, coalesce(alts[part + 1], '.') AS alt, {_sql_alleles('list_transform(gt, lambda g: CASE WHEN n < 2 THEN g ELSE list_transform(g, lambda a: CASE WHEN a IS NULL THEN NULL WHEN a = part + 1 THEN 1 ELSE 0 END) END)')} AS gts, CAST(round(CASE WHEN n < 2 THEN af[1] ELSE af[part + 1] END * 10) AS INTEGER) AS af10 FROM p")
def norm_split(spark, sf_dir):
    out = norm.split_multiallelic(variants(spark, sf_dir), HEADER)
    return out.select("row_id", "part", _list(F.col("alts")).alias("alt"), _alleles().alias("gts"), F.round(F.get("info.AF", F.lit(0)) * 10).cast("int").alias("af10"))


@q(f"""$BASE, {_PARTS} SELECT row_id, CAST(part AS INTEGER) AS part, array_to_string(list_transform([1, 2, 3, 4], lambda i: array_to_string(list_transform(CASE WHEN n < 2 THEN range(0, (n + 1) * (n + 2) // 2)
    ELSE [0, (part + 1) * (part + 2) // 2, (part + 1) * (part + 2) // 2 + part + 1] END, lambda j: (k * 7 + i * 11 + 13 * j) % 97), ',')), ' ') AS pls FROM p""")
def norm_split_genotypes(spark, sf_dir):
    """FORMAT/PL (Number=G) of split records."""
    size = ((F.size("alts") + 1) * (F.size("alts") + 2) / 2).cast("int")
    likely = lambda i: F.transform(F.sequence(F.lit(0), size - 1), lambda j: ((F.col("row_id") * 7 + (i + 1) * 11 + 13 * j) % 97).cast("int"))
    v = variants(spark, sf_dir)
    v = v.withColumn("samples", F.array(*[F.get("samples", F.lit(i)).withField("PL", likely(i)) for i in range(4)]))
    out = norm.split_multiallelic(v, HEADER.with_(formats=HEADER.formats | {"PL": Field("PL", "G", "Integer", "")}))
    return out.select("row_id", "part", F.array_join(F.transform("samples", lambda s: F.array_join(s["PL"], ",")), " ").alias("pls"))


@q(f"$BASE, {_PARTS} SELECT row_id, CAST(part AS INTEGER) AS part, array_to_string(list_transform(ad, lambda d: CASE WHEN n < 2 THEN array_to_string(d, ',') ELSE concat(list_sum(d) - d[part + 2], ',', d[part + 2]) END), ' ') AS ads FROM p")
def norm_split_keep_ad(spark, sf_dir):
    out = norm.split_multiallelic(variants(spark, sf_dir), HEADER, keep_sum=True)
    return out.select("row_id", "part", F.array_join(F.transform("samples", lambda s: F.array_join(s["AD"], ",")), " ").alias("ads"))


def _dedup(policy: str):
    def run(spark, sf_dir):
        return _keep(norm.remove_duplicates(variants(spark, sf_dir), HEADER, policy))

    return run


for _policy, _key in (("exact", "chrom, pos, ref, list_sort(alts)"), ("all", "chrom, pos")):
    QUERIES[f"norm_dedup_{_policy}"] = _dedup(_policy)
    ORACLE[f"norm_dedup_{_policy}"] = f"{BASE} SELECT {_KEEP} FROM v QUALIFY row_number() OVER (PARTITION BY {_key} ORDER BY row_id) = 1"
for _policy, _same in (("snps", "e.cls IN (1, 2) AND v.cls IN (1, 2)"), ("indels", "e.cls = 4 AND v.cls = 4"), ("both", "(e.cls IN (1, 2) AND v.cls IN (1, 2)) OR (e.cls = 4 AND v.cls = 4)")):
    QUERIES[f"norm_dedup_{_policy}"] = _dedup(_policy)
    # a dropped record shares its class with one kept before it, so the first of a class decides for all later ones
    ORACLE[f"norm_dedup_{_policy}"] = f"{BASE} SELECT {_KEEP} FROM v WHERE NOT EXISTS (SELECT 1 FROM v e WHERE e.chrom = v.chrom AND e.pos = v.pos AND e.row_id < v.row_id AND ({_same}))"


@q("SELECT row_id, row_number() OVER (ORDER BY contig_idx, pos, lower(ref), list_transform(alts, lambda a: lower(a)), n, row_id) AS place FROM v")
def norm_sort_lex(spark, sf_dir):
    ordered = norm.sort_local(variants(spark, sf_dir).where("contig_idx >= 0"), "lex")
    from pyspark.sql import Window

    # the place is checked per contig, then shifted by the contigs before, so that no window holds all rows
    w = Window.partitionBy("contig_idx").orderBy("pos", F.lower("ref"), F.transform("alts", lambda a: F.lower(a)), F.size("alts"), "row_id")
    sizes = ordered.groupBy("contig_idx").agg(F.count("*").alias("c"))
    before = sizes.withColumn("base", F.sum("c").over(Window.orderBy("contig_idx")) - F.col("c")).drop("c")
    ranked = ordered.withColumn("r", F.row_number().over(w)).join(F.broadcast(before), "contig_idx")  # one row a contig
    return ranked.select("row_id", (F.col("r") + F.col("base")).alias("place"))


@q("SELECT chrom, pos, count(*) AS records FROM v GROUP BY chrom, pos HAVING count(*) > 0")
def norm_coordinates(spark, sf_dir):
    return variants(spark, sf_dir).groupBy("chrom", "pos").agg(F.count("*").alias("records"))


@q("SELECT row_id, pos, alts FROM (SELECT min(row_id) AS row_id, pos, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT a, ',' ORDER BY a) AS alts FROM (SELECT row_id, chrom, pos, CASE WHEN n = 0 THEN NULL ELSE unnest(alts) END AS a FROM v WHERE cls = 1) GROUP BY chrom, pos)")
def norm_join_snps(spark, sf_dir):
    v = variant.bound(variants(spark, sf_dir), "ref", "alts").where(variant.record_class() == variant.SNP)
    out = norm.join_multiallelic(v, HEADER, "any", strict_ref=False)
    return out.select("row_id", "pos", F.array_join(F.array_sort("alts"), ",").alias("alts"))


def _joined_sql(group: str, more: str) -> str:
    """Records of a coordinate and group in one: {more} selects from j (rows r, longest REF, all ALTs widened and distinct)."""
    return f"""{BASE}, w AS (SELECT *, CASE WHEN cls = 64 THEN 0 ELSE cls END AS mask, {group} AS grp FROM v),
    g AS (SELECT chrom, pos, list({{'row_id': row_id, 'ref': ref, 'alts': alts, 'gt': gt, 'ph': ph}} ORDER BY CASE WHEN grp = 'all' THEN 0 ELSE mask END, row_id) AS r,
          arg_max(ref, length(ref)) AS ref FROM w GROUP BY chrom, pos, grp),
    x AS (SELECT *, list_transform(r, lambda e: list_transform(e.alts, lambda a: CASE WHEN a[1] IN ('<', '*') THEN a ELSE a || substr(ref, length(e.ref) + 1) END)) AS wide FROM g),
    j AS (SELECT *, list_filter(flatten(wide), lambda a, i: list_position(flatten(wide), a) = i) AS alts FROM x)
    SELECT r[1].row_id AS row_id, chrom, pos, ref, CASE WHEN len(alts) = 0 THEN '.' ELSE array_to_string(alts, ',') END AS alt{more} FROM j"""


#: Allele h of sample i: the first that is not REF or missing in any record, else the first record's.
_CALLED_IN = "list_transform(range(1, len(r) + 1), lambda e: CASE WHEN r[e].gt[i][h] > 0 THEN list_position(alts, wide[e][r[e].gt[i][h]]) ELSE r[e].gt[i][h] END)"
_MERGED = f"coalesce(CAST(coalesce(list_filter({_CALLED_IN}, lambda a: a > 0)[1], ({_CALLED_IN})[1]) AS VARCHAR), '.')"
_MERGED_GTS = f", array_to_string(list_transform([1, 2, 3, 4], lambda i: replace(array_to_string(list_transform([1, 2], lambda h: {_MERGED}), '/'), '/', CASE WHEN r[1].ph[i] THEN '|' ELSE '/' END)), ' ') AS gts"
ORACLE["norm_join_any"] = _joined_sql("'all'", _MERGED_GTS)
ORACLE["norm_join_both"] = _joined_sql("CASE WHEN mask IN (0, 1) THEN 'snp' WHEN mask IN (2, 4, 8) THEN CAST(mask AS VARCHAR) ELSE 'r' || row_id END", "")
ORACLE["norm_join_policy_snps"] = _joined_sql("CASE WHEN mask IN (0, 1) THEN 'snp' ELSE 'r' || row_id END", "")


@q(f"""SELECT min(row_id) AS row_id, CAST(max(qual) AS INTEGER) AS qual, CASE WHEN bool_or(filter = 'q10') THEN 'q10' ELSE arg_max(filter, row_id) END AS filter,
    string_agg(id, ';' ORDER BY row_id) FILTER (WHERE id <> '.') AS ids FROM v GROUP BY chrom, pos""")
def norm_join_fields(spark, sf_dir):
    """QUAL, FILTER and IDs of joined records."""
    out = norm.join_multiallelic(variants(spark, sf_dir), HEADER, "any", strict_ref=False)
    return out.select("row_id", F.col("qual").cast("int").alias("qual"), _list(F.col("filters"), ";").alias("filter"), F.when(F.size("ids") > 0, F.array_join("ids", ";")).alias("ids"))


@q()
def norm_join_policy_snps(spark, sf_dir):
    out = norm.join_multiallelic(variants(spark, sf_dir), HEADER, "snps", strict_ref=False)
    return out.select("row_id", "chrom", "pos", "ref", _list(F.col("alts")).alias("alt"))


@q()
def norm_join_any(spark, sf_dir):
    out = norm.join_multiallelic(variants(spark, sf_dir), HEADER, "any", strict_ref=False)
    return out.select("row_id", "chrom", "pos", "ref", _list(F.col("alts")).alias("alt"), _gts().alias("gts"))


@q()
def norm_join_both(spark, sf_dir):
    out = norm.join_multiallelic(variants(spark, sf_dir), HEADER, "both", strict_ref=False)
    return out.select("row_id", "chrom", "pos", "ref", _list(F.col("alts")).alias("alt"))


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference of a fixed pattern, 20,200 bases a contig in chunks of 4,096."""
    size, chunk = 20200, 4096
    seq = "".join("ACGTTGCAAC"[(i * i + i // 7) % 10] for i in range(size))
    rows = [(f"chr{c}", k, seq[k * chunk : (k + 1) * chunk]) for c in range(1, 6) for k in range(-(-size // chunk))]
    return spark.createDataFrame(rows, "chrom string, chunk int, seq string")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with REF taken from the reference, and an ALT that deletes, inserts or replaces behind its first base."""
    v = norm.with_reference(variants(spark, sf_dir), _reference(spark, sf_dir), 4096)
    at = F.col("pos") - F.col("context_start") + 1
    ref = F.substring("context", at, F.when(F.col("row_id") % 3 == 0, 3).otherwise(1))
    one = F.substring(ref, 1, 1)
    alt = F.when(F.col("row_id") % 3 == 0, one).when(F.col("row_id") % 3 == 1, F.concat(one, one)).otherwise(F.translate(one, "ACGT", "CGTA"))
    return v.withColumn("ref", ref).withColumn("alts", F.array(alt)).drop("context", "context_start")


_SEQ = "(SELECT string_agg(substr('ACGTTGCAAC', CAST((i * i + i // 7) % 10 + 1 AS INTEGER), 1), '' ORDER BY i) FROM range(0, 20200) t(i))"
#: What _placed makes, then one step to the left (l) or to the right (r) after the other; the last of them are kept.
_PLACED_SQL = "WITH RECURSIVE " + BASE.strip().removeprefix("WITH ") + f""", f AS (SELECT {_SEQ} AS seq),
    b AS (SELECT row_id, chrom, pos, substr(seq, pos, CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END) AS ref, substr(seq, pos, 1) AS one, k FROM v, f),
    p AS (SELECT row_id, chrom, pos, ref, CASE WHEN k % 3 = 0 THEN one WHEN k % 3 = 1 THEN one || one ELSE translate(one, 'ACGT', 'CGTA') END AS alt FROM b),
    l(row_id, chrom, pos, ref, alt) AS (SELECT row_id, chrom, CAST(pos AS BIGINT), ref, alt FROM p
        UNION ALL SELECT row_id, chrom, CASE WHEN length(ref) > 1 AND length(alt) > 1 THEN pos ELSE pos - 1 END,
            CASE WHEN length(ref) > 1 AND length(alt) > 1 THEN left(ref, -1) ELSE substr(seq, pos - 1, 1) || left(ref, -1) END,
            CASE WHEN length(ref) > 1 AND length(alt) > 1 THEN left(alt, -1) ELSE substr(seq, pos - 1, 1) || left(alt, -1) END
        FROM l, f WHERE right(ref, 1) = right(alt, 1) AND ((length(ref) > 1 AND length(alt) > 1) OR pos > 1)),
    le AS (SELECT *, list_max(list_filter(range(0, least(length(ref), length(alt))), lambda q: left(ref, q) = left(alt, q))) AS cut
        FROM l WHERE NOT (right(ref, 1) = right(alt, 1) AND ((length(ref) > 1 AND length(alt) > 1) OR pos > 1))),
    lefts AS (SELECT row_id, chrom, CAST(pos + cut AS INTEGER) AS pos, substr(ref, cut + 1) AS ref, substr(alt, cut + 1) AS alt FROM le)"""
ORACLE["norm_left_align"] = _PLACED_SQL + " SELECT * FROM lefts"
_SHRINKS, _TURNS = "(length(ref) > 1 AND length(alt) > 1 AND left(ref, 1) = left(alt, 1))", "(length(ref) <> length(alt) AND least(length(ref), length(alt)) = 1 AND left(ref, 1) = left(alt, 1))"
ORACLE["norm_right_align"] = _PLACED_SQL + f""",
    tr AS (SELECT 'chr' || (1 + s_suppkey % 5) AS tc, 1 + s_suppkey * 37 % 20000 AS a, s_suppkey * 37 % 20000 + 500 AS z, s_suppkey % 2 = 1 AS reverse FROM supplier),
    fw AS (SELECT row_id FROM p JOIN tr ON tc = chrom AND a <= pos + length(ref) AND z >= pos GROUP BY row_id HAVING NOT bool_or(reverse)),
    r(row_id, chrom, pos, ref, alt, fin) AS (SELECT row_id, chrom, CAST(pos AS BIGINT), ref, alt, CAST(pos + length(ref) - 1 AS BIGINT) FROM p JOIN fw USING (row_id)
        UNION ALL SELECT row_id, chrom, pos + 1, CASE WHEN {_SHRINKS} THEN substr(ref, 2) ELSE substr(ref, 2) || substr(seq, fin + 1, 1) END,
            CASE WHEN {_SHRINKS} THEN substr(alt, 2) ELSE substr(alt, 2) || substr(seq, fin + 1, 1) END, CASE WHEN {_SHRINKS} THEN fin ELSE fin + 1 END
        FROM r, f WHERE {_SHRINKS} OR {_TURNS})
    SELECT row_id, chrom, CAST(pos AS INTEGER) AS pos, ref, alt FROM r WHERE NOT ({_SHRINKS} OR {_TURNS}) UNION ALL SELECT * FROM lefts WHERE row_id NOT IN (SELECT row_id FROM fw)"""


@q()
def norm_left_align(spark, sf_dir):
    return _keep(norm.normalize(_placed(spark, sf_dir), _reference(spark, sf_dir), 4096))


@q()
def norm_right_align(spark, sf_dir):
    transcripts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("chr"), (1 + F.col("s_suppkey") % 5).cast("string")).alias("chrom"), (1 + F.col("s_suppkey") * 37 % 20000).cast("int").alias("start"), (F.col("s_suppkey") * 37 % 20000 + 500).cast("int").alias("end"), (F.col("s_suppkey") % 2 == 1).alias("reverse"))
    return _keep(norm.normalize(_placed(spark, sf_dir), _reference(spark, sf_dir), 4096, transcripts))


def _checked(mode: str):
    def run(spark, sf_dir):
        out = norm.check_reference(variants(spark, sf_dir), _reference(spark, sf_dir), mode, 4096)
        return out.select("row_id", "mismatch") if mode == "w" else _keep(out)

    return run


QUERIES["norm_check_ref_warn"] = _checked("w")
ORACLE["norm_check_ref_warn"] = f"{BASE}, f AS (SELECT {_SEQ} AS seq) SELECT row_id, ref <> substr(seq, pos, length(ref)) AS mismatch FROM v, f"
QUERIES["norm_check_ref_skip"] = _checked("x")
ORACLE["norm_check_ref_skip"] = f"{BASE}, f AS (SELECT {_SEQ} AS seq) SELECT {_KEEP} FROM v, f WHERE ref = substr(seq, pos, length(ref))"
QUERIES["norm_check_ref_fix"] = _checked("s")
_REAL = "substr(seq, pos, length(ref))"
_FOLLOW = f"CASE WHEN a[1] IN ('<', '*') THEN a ELSE array_to_string(list_transform(string_split(a, ''), lambda c, i: CASE WHEN i <= length(ref) AND c = substr(ref, CAST(i AS BIGINT), 1) THEN substr({_REAL}, CAST(i AS BIGINT), 1) ELSE c END), '') END"
_FIXED = f"CASE WHEN ref = {_REAL} THEN alts WHEN list_contains(alts, {_REAL}) THEN list_transform(alts, lambda a, i: CASE WHEN i = list_position(alts, {_REAL}) THEN ref ELSE a END) ELSE list_transform(alts, lambda a: {_FOLLOW}) END"
_TURNED_CALL = "CASE WHEN place > 0 AND a = 0 THEN place WHEN place > 0 AND a = place THEN 0 ELSE a END"
_FIXED_SQL = f"""{BASE}, f AS (SELECT {_SEQ} AS seq), x AS (SELECT *, {_REAL} AS real_ref, CASE WHEN ref = {_REAL} THEN 0 ELSE coalesce(list_position(alts, {_REAL}), 0) END AS place, {_FIXED} AS fixed FROM v, f),
    y AS (SELECT *, list_filter(fixed, lambda a: a <> real_ref) AS kept FROM x)"""
ORACLE["norm_check_ref_fix"] = f"{_FIXED_SQL} SELECT row_id, chrom, pos, real_ref AS ref, CASE WHEN len(kept) = 0 THEN '.' ELSE array_to_string(kept, ',') END AS alt FROM y"


@q()
def norm_check_ref_fix_calls(spark, sf_dir):
    """Calls, and INFO/AC where REF and an ALT change places, after the repair."""
    header = HEADER.with_(infos=HEADER.infos | {"AC": Field("AC", "A", "Integer", "")})
    v = variants(spark, sf_dir).withColumn("info", F.col("info").withField("AC", F.transform("alts", lambda a, i: (i + 100).cast("int"))))
    out = norm.check_reference(v, _reference(spark, sf_dir), "s", 4096)
    return out.select("row_id", _alleles().alias("gts"), F.array_join("info.AC", ",").alias("ac"))


ORACLE["norm_check_ref_fix_calls"] = f"""{_FIXED_SQL} SELECT row_id, {_sql_alleles(f"list_transform(gt, lambda g: list_transform(g, lambda a: CASE WHEN ({_TURNED_CALL}) > 0 THEN coalesce(list_position(kept, nullif(fixed[{_TURNED_CALL}], real_ref)), 0) ELSE ({_TURNED_CALL}) END))")} AS gts,
    array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i = place THEN len(list_filter(flatten(gt), lambda a: a = 0)) ELSE 99 + i END), ',') AS ac FROM y"""


@q(f"""$BASE, p AS (SELECT *, unnest(range(0, CASE WHEN coalesce(qual > 50, false) THEN greatest(n, 1) ELSE 1 END)) AS part FROM v)
    SELECT row_id, CAST(part AS INTEGER) AS part, CASE WHEN n = 0 THEN '.' WHEN coalesce(qual > 50, false) THEN alts[part + 1] ELSE alt END AS alt FROM p""")
def norm_split_selected(spark, sf_dir):
    out = norm.selected(variants(spark, sf_dir), HEADER, lambda df: norm.split_multiallelic(df, HEADER), include="QUAL > 50")
    return out.select("row_id", "part", _list(F.col("alts")).alias("alt"))


@q("""SELECT row_id, pos + o AS pos, ref1 AS ref, alt1 AS alt FROM (
    SELECT row_id, pos, unnest(CASE WHEN cls = 2 THEN [0, 1] ELSE [0] END) AS o, unnest(CASE WHEN cls = 2 THEN [left(ref, 1), right(ref, 1)] ELSE [ref] END) AS ref1,
           unnest(CASE WHEN cls = 2 THEN [left(alt, 1), right(alt, 1)] ELSE [alt] END) AS alt1 FROM v WHERE n = 1 AND cls IN (1, 2, 4))""")
def norm_atomize(spark, sf_dir):
    v = variants(spark, sf_dir)
    v = v.where((F.size("alts") == 1) & variant.record_class().isin(variant.SNP, variant.MNP, variant.INDEL))
    return _keep(norm.atomize(v, HEADER)[0]).drop("chrom")


@q("SELECT row_id, concat_ws('|', chrom, CAST(pos AS VARCHAR), ref, alt, '1') AS origin FROM (SELECT *, unnest([0, 1]) AS o FROM v WHERE cls = 2)")
def norm_old_rec_tag(spark, sf_dir):
    v = variants(spark, sf_dir).where(variant.record_class() == variant.MNP)
    out, _ = norm.atomize(v, HEADER, old_rec_tag="OLD")
    return out.select("row_id", F.col("info.OLD").alias("origin"))


def _numbers(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")


@q()
def norm_atomize_all(spark, sf_dir):
    """Atoms of all variants: several ALTs, '*', symbolic alleles and records without an ALT too."""
    out = norm.atomize(variants(spark, sf_dir), HEADER)[0]
    depths = F.array_join(F.transform("samples", lambda s: _numbers(s["AD"])), " ")
    af10 = _numbers(F.transform("info.AF", lambda a: F.round(a * 10).cast("int")))
    return out.select("row_id", "part", "chrom", "pos", "ref", _list(F.col("alts")).alias("alt"), af10.alias("af10"), _alleles().alias("gts"), depths.alias("ad"))


@q()
def norm_old_rec_tag_all(spark, sf_dir):
    """The origin of the atoms of all variants, null for a record that stays as it is."""
    out, _ = norm.atomize(variants(spark, sf_dir), HEADER, old_rec_tag="OLD")
    return out.select("row_id", "part", "pos", "ref", _list(F.col("alts")).alias("alt"), F.col("info.OLD").alias("origin"))


# ---------------------------------------------------------------- validation, headers, statistics

_TRIM = "t AS (SELECT row_id, chrom, pos AS p, ref AS r, unnest(alts) AS a FROM v)"


@q("SELECT row_id, 'record.duplicate-alt' AS code, 'ALT' AS field FROM v WHERE len(list_distinct(alts)) < n UNION ALL SELECT row_id, 'record.cardinality', 'INFO/AF' FROM v WHERE n = 0 UNION ALL SELECT row_id, 'record.contig-bound', 'POS' FROM v WHERE pos > 20101")
def validate_record_codes(spark, sf_dir):
    return validate.validate_records(variants(spark, sf_dir), HEADER)


@q("SELECT row_id, CASE WHEN c0 > contig_idx THEN 'contig-order' ELSE 'position-order' END AS problem FROM (SELECT row_id, contig_idx, pos, lag(contig_idx) OVER (ORDER BY row_id) AS c0, lag(pos) OVER (ORDER BY row_id) AS p0 FROM v) WHERE c0 > contig_idx OR (c0 = contig_idx AND p0 > pos)")
def validate_order(spark, sf_dir):
    return norm.check_order(variants(spark, sf_dir))


@q(f"$BASE, {_TRIM} SELECT DISTINCT l.row_id, 'record.duplicate-variant' AS code, 'ALT' AS field FROM t l JOIN t e ON e.chrom = l.chrom AND e.p = l.p AND e.r = l.r AND e.a = l.a AND e.row_id < l.row_id")
def validate_duplicates(spark, sf_dir):
    return validate.duplicate_variants(variants(spark, sf_dir))


@q("SELECT count(*) AS with_evidence FROM v WHERE k % 3 = 0")
def validate_evidence(spark, sf_dir):
    v = variants(spark, sf_dir).drop("samples")
    v = v.withColumn("info", F.col("info").withField("AF", F.when(F.col("row_id") % 3 == 0, F.col("info.AF"))))
    return v.where(validate.evidence(HEADER.with_(samples=(), formats={}))).agg(F.count("*").alias("with_evidence"))


@q(f"""$BASE, {_TRIM}, d AS (SELECT DISTINCT l.row_id FROM t l JOIN t e ON e.chrom = l.chrom AND e.p = l.p AND e.r = l.r AND e.a = l.a AND e.row_id < l.row_id),
    o AS (SELECT contig_idx, pos, lag(contig_idx) OVER (ORDER BY row_id) AS c0, lag(pos) OVER (ORDER BY row_id) AS p0 FROM v),
    e AS (SELECT (SELECT count(*) FROM d) + (SELECT count(*) FROM o WHERE c0 > contig_idx OR (c0 = contig_idx AND p0 > pos)) + (SELECT count(*) FROM v WHERE n = 0) AS errors)
    SELECT 'VCFv4.3' AS version, (SELECT count(*) FROM v) AS records, errors, least(errors, 100) AS shown, errors > 100 AS truncated FROM e""")
def validate_summary(spark, sf_dir):
    return validate.report(variants(spark, sf_dir), HEADER)


#: What record k % 16 has wrong: the column that changes, its text, and the code.
_FAULTS = {
    1: ("info", "DP=x", "value-type"), 2: ("info", "DP=", "empty-value"), 3: ("info", "DP", "missing-value"), 4: ("info", "AF=2", "value-range"), 5: ("info", "DP=1;DP=2", "duplicate-info"), 6: ("qual", "-5", "qual"),
    7: ("id", "a;a", "duplicate-id"), 8: ("ref", "R", "ref"), 9: ("alt", "<", "alt"), 10: ("filter", "0", "filter"), 11: ("info", "9x=1", "info-key"), 12: ("info", "DB=7", "flag-value"), 13: ("info", "DP=-1", "value-range"),
    14: ("pos", "x", "pos"), 15: ("info", "DP=1\tmore", "columns"),
}


@q(f"""SELECT row_id, 'record.' || CASE CAST(k % 16 AS INTEGER) {' '.join(f"WHEN {k} THEN '{code}'" for k, (_, _, code) in _FAULTS.items())} END AS code FROM v WHERE k % 16 > 0
    UNION ALL SELECT row_id, 'record.cardinality' FROM v WHERE k % 16 = 4 AND n <> 1""")
def validate_text_codes(spark, sf_dir):
    v = variants(spark, sf_dir)
    text = {"chrom": F.col("chrom"), "pos": F.col("pos").cast("string"), "id": _list(F.col("ids"), ";"), "ref": F.col("ref"), "alt": _list(F.col("alts")), "qual": F.coalesce(F.col("qual").cast("int").cast("string"), F.lit(".")), "filter": _list(F.col("filters"), ";"), "info": F.concat(F.lit("DP="), F.col("info.DP").cast("string"))}
    for k, (column, wrong, _) in _FAULTS.items():
        text[column] = F.when(F.col("row_id") % 16 == k, wrong).otherwise(text[column])
    lines = v.select("row_id", F.concat_ws("\t", *text.values()).alias("value"))
    _, schema = validate_text.header_problems("".join(f"{line}\n" for line in HEADER.with_(samples=(), formats={}).lines()))
    return validate_text.line_problems(lines, schema).select("row_id", "code")


def _round_trip(compress: bool | str):
    def run(spark, sf_dir):
        shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="variform-")
        path = f"{shared.rstrip('/')}/variform-{uuid.uuid4().hex}"
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        vcf.write_vcf(variants(spark, sf_dir), HEADER, path, compress=compress)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
        back, header = vcf.read_vcf(spark, path)
        if header.lines() != HEADER.lines():
            raise AssertionError("the header came back otherwise")
        tenths = F.array_join(F.transform("info.AF", lambda a: F.round(a * 10).cast("int").cast("string")), ",")
        return back.select("chrom", "contig_idx", "pos", _list(F.col("ids"), ";").alias("id"), "ref", _list(F.col("alts")).alias("alt"), "qual", _list(F.col("filters"), ";").alias("filter"), F.col("info.DP").alias("dp"), tenths.alias("af10"), F.col("info.DB").alias("db"), _gts().alias("gts"))

    return run


for _name, _compress in (("vcf_roundtrip", False), ("vcf_roundtrip_bgzf", "bgzf")):
    QUERIES[_name] = _round_trip(_compress)
    ORACLE[_name] = f"{BASE} SELECT chrom, contig_idx, pos, id, ref, alt, qual, filter, dp, array_to_string(list_transform(af, lambda a: CAST(CAST(round(a * 10) AS INTEGER) AS VARCHAR)), ',') AS af10, k % 4 = 0 AS db, array_to_string(list_transform([1, 2, 3, 4], lambda i: {_GT_TEXT}), ' ') AS gts FROM v"


@q("$BASE SELECT 'A,S2,S3,D' AS samples")
def reheader_samples(spark, sf_dir):
    return spark.range(1).select(F.lit(",".join(HEADER.rename_samples(["S1 A", "S4 D"]).samples)).alias("samples"))


@q("SELECT row_id, array_to_string(list_transform([1, 2, 3, 4], lambda i: concat(['A', 'S2', 'S3', 'D'][i], '=', coalesce(CAST(sdp[i] AS VARCHAR), '.'))), ' ') AS value FROM v")
def reheader_rows(spark, sf_dir):
    """Rows under renamed samples."""
    out = query(variants(spark, sf_dir), HEADER.rename_samples(["S1 A", "S4 D"]), "[%SAMPLE=%DP ]")
    return out.select("row_id", F.rtrim("value").alias("value"))


@q("$BASE SELECT * FROM (VALUES (0, 'chr1', 5000), (1, 'chr3', 20100), (2, 'chrX', 77)) AS t(idx, contig, length)")
def reheader_contigs(spark, sf_dir):
    header = HEADER.sync_contigs([("chrX", 77), ("chr3", 20100), ("chr1", 5000)])
    return spark.createDataFrame([(i, c, int(f["length"])) for i, (c, f) in enumerate(header.contigs.items())], "idx int, contig string, length int")


@q("SELECT contig_idx, chrom, 20100 AS length, count(*) AS records FROM v GROUP BY contig_idx, chrom")
def index_stats(spark, sf_dir):
    return view.contig_stats(variants(spark, sf_dir), HEADER, all_contigs=True)


@q("SELECT count(*) AS records FROM v")
def index_nrecords(spark, sf_dir):
    return variants(spark, sf_dir).agg(F.count("*").alias("records"))


@q("SELECT row_id, CASE WHEN k % 5 = 0 THEN pos + 40 WHEN alt = '<DEL>' THEN pos + greatest(length(ref), k % 90) - 1 ELSE pos + length(ref) - 1 END AS last FROM v")
def index_interval(spark, sf_dir):
    header = HEADER.with_(infos=HEADER.infos | {"END": Field("END", "1", "Integer", ""), "SVLEN": Field("SVLEN", "A", "Integer", "")})
    v = variants(spark, sf_dir)
    info = F.col("info").withField("END", F.when(F.col("row_id") % 5 == 0, F.col("pos") + 40)).withField("SVLEN", F.array(-(F.col("row_id") % 90).cast("int")))
    return v.withColumn("info", info).select("row_id", view.index_end(header).cast("long").alias("last"))
