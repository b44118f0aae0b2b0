"""What a query costs as its tables grow."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_catalog import rows
from variform.functions import variant
from variform.functions.expression import compile_truth
from variform.operators import annotate, filtering, norm, setgt
from variform.plans import catalog
from variform.sources.derived import HEADER, variants
from variform.sources.header import VariantHeader

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_source_rows_are_spread(spark):
    assert variants(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_site_conditions_read_columns_made_once(spark):
    v = variants(spark, SF)
    for text in ("MAX(FMT/DP) > 40", "N_PASS(FMT/DP > 20) >= 3", "AC > 3 && MAF > 0.3", "ILEN < 0", "F_MISSING = 0.75", "COUNT(FMT/DP) < 4"):
        out, _ = filtering.filter_variants(v, HEADER, include=text)
        filters = [line for line in _plan(out).split("\n") if "Filter " in line]
        assert filters and not any("CASE WHEN (t#" in line or "split(" in line or "o_orderkey" in line for line in filters), text


def test_bound_keeps_rows_and_order_of_columns(spark):
    v = variants(spark, SF)
    names = variant.mentioned(v, compile_truth("INFO/DP > 10 && FMT/DP > 5", HEADER).site)
    out = variant.bound(v, *names)
    assert names == ["info", "samples"] and out.columns == v.columns
    assert out.exceptAll(v).isEmpty() and v.exceptAll(out).isEmpty()


def test_minor_allele_is_ranked_once(spark):
    out = setgt.set_genotypes(variants(spark, SF).where(F.size("alts") > 0), HEADER, "./x", "m")
    assert "Generate explode" in _plan(out)


def test_join_of_records_with_other_refs(spark):
    v = variants(spark, SF)
    two = v.orderBy("row_id").limit(2).withColumn("pos", F.lit(7)).withColumn("chrom", F.lit("chr1"))
    two = two.withColumn("ref", F.when(F.col("row_id") % 2 == 0, "A").otherwise("CG")).withColumn("alts", F.array(F.lit("T")))
    got = norm.join_multiallelic(two, HEADER, "any", strict_ref=False).collect()
    assert [(r.row_id, r.ref, r.alts) for r in got] == [(0, "CG", ["TG", "T"])]
    try:
        norm.join_multiallelic(two, HEADER, "any").collect()
    except Exception as error:
        assert "incompatible REF" in str(error)
    else:
        raise AssertionError("other REFs are an error")


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """Orders whose copies fall on the same loci with other alleles."""
    folder = tmp_path_factory.mktemp("dense")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT o.* REPLACE (o_orderkey + 200110 * j AS o_orderkey) FROM '{SF}/orders.parquet' o, range(4) r(j)) TO '{folder}/orders.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * FROM '{SF}/part.parquet') TO '{folder}/part.parquet' (FORMAT parquet)")
    for t in ("orders", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c, str(folder)


@pytest.mark.parametrize("name", ["norm_join_snps", "norm_join_fields", "ann_pair_all", "ann_pair_both", "ann_pair_id", "ann_pair_some", "ann_format_samples", "ann_interval_all", "ann_min_overlap", "ann_write_missing", "ann_tab_id", "ann_tab_alleles"])
def test_dense_loci(spark, dense, name):
    duck, folder = dense
    got = catalog.QUERIES[name](spark, folder).toPandas()
    assert rows(got) == rows(duck.sql(catalog.ORACLE[name]).df())


def test_records_of_one_span_meet_sources_once(spark):
    schema = "row_id long, chrom string, pos int, ref string, alts array<string>, ids array<string>"
    v = spark.createDataFrame([(k, "chr1", 5, "A", ["C"], []) for k in range(200)], schema)
    sources = spark.createDataFrame([(k, "chr1", 1, 9) for k in range(100)], "serial long, chrom string, `from` int, `to` int")
    targets, keys, pairs = annotate._span_pairs(v, VariantHeader(), sources, None, frozenset())
    assert pairs.count() == 100
    assert annotate.match_intervals(v, VariantHeader(), sources, first=False).count() == 20000
    assert {(r.row_id, r.serial) for r in annotate.match_intervals(v, VariantHeader(), sources).collect()} == {(k, 0) for k in range(200)}


def test_covered_places_and_spans_of_transcripts(spark):
    r = random.Random(4)
    places = [(r.choice("xy"), a := r.randrange(1, 600), a + r.choice([0, 1, 9, 200])) for _ in range(120)]
    held = {(c, p) for c, a, b in places for p in range(a, b + 1)}
    for width in (1, 16, 8192):
        got = norm.covered(spark.createDataFrame(places * 2, "chrom string, `from` int, `to` int"), width).collect()
        told = [(x.chrom, p) for x in got for p in range(x["from"], x.to + 1)]
        assert len(told) == len(set(told)) and set(told) == held
    v = spark.createDataFrame([(k, "x", 10 + k % 3, "A", ["C"]) for k in range(300)], "row_id long, chrom string, pos int, ref string, alts array<string>")
    strands = [("x", 1, 11, False)] * 50 + [("x", 13, 20, True), ("x", 1, 30, None)]
    found = norm.transcript_direction(v, spark.createDataFrame(strands, "chrom string, start int, end int, reverse boolean"))
    assert sorted(tuple(x) for x in found.collect()) == [("x", 10, 11, True), ("x", 11, 12, True), ("x", 12, 13, False)]
