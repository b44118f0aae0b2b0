import random

import numpy as np

from variform.llm.decontaminate import Bm25Index, build_slices, contamination, drop_contaminated, words


def items(r, n=60):
    return [(i, " ".join(f"w{r.randrange(400)}" for _ in range(r.randint(6, 40))), None) for i in range(n)]


def test_wand_finds_all_above_threshold():
    r = random.Random(1)
    index = Bm25Index(items(r))
    for _ in range(300):
        query = sorted(set(r.sample(range(len(index.terms)), 30)) | {index.terms[w] for w in words(r.choice(index.items)[1])})
        scores = np.zeros(len(index.items))
        for t in query:
            for i, x in zip(*index.lists[t], strict=True):
                scores[i] += x
        for threshold in (0.05, 0.2, 0.6):
            assert [i for i, _ in index.wand(query, threshold)] == [i for i, s in enumerate(scores) if s >= threshold - 1e-9]


def test_documents_that_hold_items(spark):
    r = random.Random(2)
    bench = items(r, 40)
    rows, want = [], set()
    for d in range(80):
        text = [f"f{r.randrange(900)}" for _ in range(r.randint(0, 300))]
        if d % 3 == 0:
            i, q, _ = r.choice(bench)
            at = r.randint(0, len(text))
            text[at:at] = q.upper().split()
            want.add((d, i))
        rows.append((d, " ".join(text), "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, "w1 " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    table = spark.createDataFrame([(i, q) for i, q, _ in bench] + [(90, None), (91, "")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in contamination(df, table).collect()} == want
    kept = drop_contaminated(df, table)
    assert {x.doc_id for x in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in want} and kept.columns == df.columns
    assert contamination(df, table.limit(0)).count() == 0 and contamination(df.limit(0), table).count() == 0


def test_answers_must_stand_in_the_passage(spark):
    table = spark.createDataFrame([(1, "what is the capital of this far land called", "port elm")], "item_id int, text string, answer string")
    q = "what is the capital of this far land called"
    df = spark.createDataFrame([(1, f"{q}? Port Elm!"), (2, f"{q}? elm port")], "doc_id long, text string")
    assert [x.doc_id for x in contamination(df, table, answer_col="answer", threshold=0.5).collect()] == [1]


def test_slices_give_the_scores_of_one_index(spark):
    r = random.Random(6)
    # the first items repeat one another's words, so that a slice's own frequencies are far from those of all
    bench = [(i, " ".join(f"w{r.randrange(30 if i < 40 else 400)}" for _ in range(r.randint(6, 40)))) for i in range(120)]
    table = spark.createDataFrame(bench, "item_id long, text string").coalesce(1)
    one, many = list(build_slices(table)), list(build_slices(table, slice_bytes=900))
    assert len(one) == 1 < len(many) and sum(len(x.items) for x in many) == len(one[0].items) == 120
    for _ in range(40):
        text = " ".join(f"w{r.randrange(400)}" for _ in range(50)) + " " + " ".join(r.choice(bench)[1].split()[: r.randint(4, 40)])
        found = [{x.items[i][0]: (round(s, 6), o) for i, (s, o) in x.search(text, 0.3, 0.1).items()} for x in (*one, *many)]
        assert found[0] == {k: v for part in found[1:] for k, v in part.items()}


def test_passes_over_slices_find_what_one_does(spark):
    r = random.Random(7)
    bench = [(i, q) for i, q, _ in items(r, 30)]
    table = spark.createDataFrame(bench, "item_id long, text string").coalesce(1)
    rows = [(d, " ".join([*(f"f{r.randrange(90)}" for _ in range(20)), *(bench[d][1].split() if d % 2 else [])]), "m") for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    found = [sorted((x.doc_id, x.item_id, x.score) for x in contamination(df, table, slice_bytes=n).collect()) for n in (1 << 20, 700)]
    assert found[0] == found[1] and [x[:2] for x in found[0]] == [(d, d) for d in range(1, 30, 2)]
    out = drop_contaminated(df, table, slice_bytes=700)
    assert sorted(x.doc_id for x in out.collect()) == list(range(0, 30, 2)) and out.columns == df.columns and out.first().matches == "m"
