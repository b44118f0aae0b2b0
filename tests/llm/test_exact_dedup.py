from pyspark.sql import functions as F

from variform.llm.exact_dedup import DigestIndex, drop_exact_copies, exact_groups

SCHEMA = "doc_id long, text string, digest string, keep_id int"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(x for x in groups[t or ""]), len(groups[t or ""])) for i, t, *_ in rows)


def test_groups_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a", "x", 1), (2, "a", "y", 2), (3, None, None, None), (4, "", "z", 4), (5, "b" * 100_000, "q", 5), (5, "b" * 100_000, "q", 5), (6, "é", "q", 6)]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA), keep="largest").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest_collisions_are_split_by_bytes(spark):
    rows = [(i, f"t{i % 3}", None, None) for i in range(30)]
    weak = DigestIndex(memtables=2, digest=lambda t: F.lit(b"same"))
    got = weak.add(spark.createDataFrame(rows, SCHEMA)).resolve().collect()
    assert sorted((r.id, r.max_id, r.n) for r in got) == brute(rows)


def test_incremental_batches_compact(spark):
    rows = [(i, f"t{i % 7}", None, None) for i in range(40)]
    index = DigestIndex(memtables=2, fanout=2)
    for k in range(4):
        index.add(spark.createDataFrame(rows[k * 10 : k * 10 + 10], SCHEMA))
    got = index.resolve().collect()
    assert sorted((r.id, r.max_id, r.n) for r in got) == brute(rows)
    kept = drop_exact_copies(spark.createDataFrame(rows, SCHEMA)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(7))


def test_rows_of_a_repeated_identifier_are_told_apart(spark):
    rows = [(1, "X", "a", 1), (3, "X", "b", 2), (3, "quite another text", "c", 3), (4, "Y", "d", 4), (4, "Y", "e", 5), (None, "Z", "f", 6), (None, "Z", "g", 7), (None, None, "h", 8), (5, "", "i", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, same int")
    for keep, x in (("smallest", 1), ("largest", 3)):
        out = drop_exact_copies(df, keep=keep)
        assert out.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert got == sorted([(x, "X"), (3, "quite another text"), (4, "Y"), (None, "Z"), (5, "")], key=str)
    weak = DigestIndex(digest=lambda t: F.lit(b"same")).add(df)
    assert sorted((r.n for r in weak.resolve().collect())) == [1, 2, 2, 2, 2, 2, 2, 2, 2]


def test_runs_are_probed_through_filters(spark):
    texts = [f"t{i}" for i in range(500)] + ["t7", "t8"] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    index = DigestIndex(memtables=4).add(df)
    made, _, filters = index.runs[0]
    assert made.select("run").distinct().count() == 4
    in_runs = made.groupBy("digest").agg(F.count("*").alias("runs"))
    probed = filters.may_be_elsewhere(made, 4).join(in_runs, "digest")
    assert probed.where("runs > 1 AND NOT _found").count() == 0 and probed.where("runs = 1 AND _found").count() < 120
    assert index.compact().count() == 500 and index.compact().agg(F.sum("n")).first()[0] == 700


def test_hot_groups_are_joined_in_parts(spark):
    from variform.llm import exact_dedup

    old, exact_dedup.BROADCAST_BYTES = exact_dedup.BROADCAST_BYTES, 0
    rows = [(i, "hot" if i % 3 else f"t{i}", None, None) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_groups(df, keep="largest").collect())
    n_kept = drop_exact_copies(df).count()
    exact_dedup.BROADCAST_BYTES = old
    assert got == brute(rows) and n_kept == 301
