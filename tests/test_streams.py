"""The streaming forms against the batch ones, over files that arrive one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from variform.operators import annotate, filtering
from variform.sources.derived import HEADER, intervals, variants
from variform.streaming import streams

SF = "/root/testdata/sf0.001"


def ordered(spark, order=("chrom", "pos", "row_id")):
    """The records of a sorted file: row_id follows contig and position."""
    rows = variants(spark, SF).orderBy(*order).collect()
    return [r.asDict(recursive=False) | {"row_id": i} for i, r in enumerate(rows)]


def stream_of(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
        (next((folder / f"b{k}").glob("*.parquet"))).rename(folder / f"in-{k:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder / "in-*.parquet"))


def run(spark, df, folder, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect()


def ends(rows, schema):
    """A row of a null position for every contig, which ends it."""
    blank = dict.fromkeys(schema.fieldNames())
    seen = {r["chrom"]: r["contig_idx"] for r in rows}
    return [blank | {"chrom": c, "contig_idx": i} for c, i in seen.items()]


def test_reordered_gives_the_records_back_in_order(spark, tmp_path):
    schema = spark.createDataFrame([], HEADER.schema()).schema
    rows = ordered(spark)[:900]
    mixed = list(rows)
    r = random.Random(2)
    for _ in range(400):
        i = r.randrange(len(mixed) - 1)
        if mixed[i]["chrom"] == mixed[i + 1]["chrom"]:
            mixed[i], mixed[i + 1] = mixed[i + 1], mixed[i]
    batches = [mixed[i : i + 150] for i in range(0, len(mixed), 150)] + [ends(rows, schema)]
    out = run(spark, streams.reordered(stream_of(spark, tmp_path, batches, schema), 3000), tmp_path, "reordered")
    for c in {x["chrom"] for x in rows}:
        assert [(x.pos, x.row_id) for x in out if x.chrom == c] == [(x["pos"], x["row_id"]) for x in rows if x["chrom"] == c]
    want = {x["row_id"]: x for x in rows}
    assert all(x.asDict(recursive=False) == want[x.row_id] for x in out) and len(out) == len(rows)


def test_a_contig_that_the_watermark_has_passed_is_complete(spark, tmp_path):
    schema = spark.createDataFrame([], HEADER.schema()).schema
    rows = [x for x in ordered(spark) if x["chrom"] in ("chr1", "chr2")]
    first, second = [x for x in rows if x["chrom"] == "chr1"][:40], [x for x in rows if x["chrom"] == "chr2"][:40]
    out = run(spark, streams.reordered(stream_of(spark, tmp_path, [first, second[:20], second[20:30], second[30:]], schema), 50), tmp_path, "completed")
    assert [x.row_id for x in out if x.chrom == "chr1"] == [x["row_id"] for x in first]


def test_late_records_are_an_error(spark, tmp_path):
    schema = spark.createDataFrame([], HEADER.schema()).schema
    rows = [x for x in ordered(spark) if x["chrom"] == "chr1"][:60]
    df = streams.reordered(stream_of(spark, tmp_path, [rows[30:], rows[:30]], schema), 10)
    with pytest.raises(Exception, match="later than the reorder window"):
        run(spark, df, tmp_path, "late")


@pytest.mark.parametrize("snp, indel", [(3, None), ((200, "indel,snp"), None), (None, 2), (None, 60), (5, 30)])
def test_gap_marks_equal_the_batch_filters(spark, tmp_path, snp, indel):
    schema = spark.createDataFrame([], HEADER.schema()).schema
    rows = ordered(spark)
    batches = [rows[i : i + 300] for i in range(0, len(rows), 300)] + [ends(rows, schema)]
    out = run(spark, streams.gap_marked(stream_of(spark, tmp_path, batches, schema), HEADER, snp=snp, indel=indel), tmp_path, f"gaps{abs(hash((snp, indel)))}")
    batch = spark.createDataFrame(rows, schema)
    want = {"SnpGap": set(), "IndelGap": set()}
    if snp is not None:
        want["SnpGap"] = {r.row_id for r in filtering.snp_gap(batch, *(snp if isinstance(snp, tuple) else (snp, "indel"))).collect()}
    if indel is not None:
        want["IndelGap"] = {r.row_id for r in filtering.indel_gap(batch, HEADER, indel).collect()}
    assert len(out) == len(rows) and any(want.values())
    for name, ids in want.items():
        assert {x.row_id for x in out if name in x.marks} == ids
    for c in {x["chrom"] for x in rows}:
        assert [x.row_id for x in out if x.chrom == c] == [x["row_id"] for x in rows if x["chrom"] == c]


def test_gap_marks_need_sorted_records(spark, tmp_path):
    schema = spark.createDataFrame([], HEADER.schema()).schema
    rows = [x for x in ordered(spark) if x["chrom"] == "chr1"][:20]
    turned = [x | {"row_id": i} for i, x in enumerate(reversed(rows))]
    with pytest.raises(Exception, match="need sorted records"):
        run(spark, streams.gap_marked(stream_of(spark, tmp_path, [turned], schema), HEADER, snp=3), tmp_path, "unsorted")


def test_intervals_and_duplicates(spark, tmp_path):
    schema = spark.createDataFrame([], HEADER.schema()).schema
    rows = ordered(spark)[:500]
    df = stream_of(spark, tmp_path, [rows[:250], rows[250:]], schema)
    got = {(r.row_id, r.serial) for r in run(spark, streams.annotated(df, HEADER, intervals(spark, SF)).select("row_id", "serial"), tmp_path, "annotated")}
    want = annotate.match_intervals(spark.createDataFrame(rows, schema), HEADER, intervals(spark, SF), first=False)
    assert got == {(r.row_id, r.serial) for r in want.collect()} and got
    twice = [rows, [x | {"row_id": x["row_id"] + 10_000} for x in rows]]
    (tmp_path / "d").mkdir()
    out = run(spark, streams.deduplicated(stream_of(spark, tmp_path / "d", twice, schema), 1 << 30), tmp_path / "d", "dedup")
    keys = {(x["chrom"], x["pos"], x["ref"], tuple(sorted(x["alts"]))) for x in rows}
    assert len(out) == len(keys) and all(x.row_id < 10_000 for x in out)
    assert spark.createDataFrame(rows, schema).select(F.count("*")).first()[0] == 500
