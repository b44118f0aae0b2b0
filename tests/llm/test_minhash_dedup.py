import random

from variform.llm.minhash_dedup import Signer, drop_near_copies, near_groups, shingle_set

SCHEMA = "doc_id long, text string, component_id string, n long"


def words(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k):
    sets = [(i, words(t, k)) for i, t in rows]
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(s), label[i]) for i, s in sets}


def corpus(seed, n_groups=12, copies=14):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(n_groups):
        origin = [r.choice(vocab) for _ in range(r.randint(8, 80))]
        for _ in range(copies):
            text = list(origin)
            for _ in range(r.randint(0, 1 + len(text) // 12)):
                text[r.randrange(len(text))] = r.choice(vocab)
            rows.append((i, " ".join(text)))
            i += 1
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus(3) + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one  two"), (906, "one\ttwo"), (907, "x " * 40_000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, shingle_words=2).collect()}
    assert got == brute(rows, 2)


def test_filter_keeps_one_of_each_group(spark):
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t" + (" u" if i % 2 else ""), None, i) for i in range(20)] + [(50, "other text that stands alone in here", "x", 1), (None, "other text that stands alone in here", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = drop_near_copies(df)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 50), (True, 0)]
    assert kept.columns == df.columns


def test_empty_table(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_odd_sketch_estimates_high_similarity():
    signer = Signer()
    import numpy as np

    base = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for share in (1.0, 0.95, 0.85):
        other = base.copy()
        other[int(len(base) * share) :] += np.uint64(12345)
        truth = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        a, b = (signer.sign(np.unique(x))[1].view(np.uint8) for x in (base, other))
        z = int(np.unpackbits(a ^ b).sum())
        estimate = 1 + signer.bits / 4 / 160 * np.log(max(1e-3, 1 - 2 * z / signer.bits))
        assert abs(estimate - truth) < 0.12
    assert len(shingle_set("a b c", 5)) == 1


def test_repeated_identifiers_are_told_apart_by_text(spark):
    y = [f"y{i}" for i in range(60)]
    y2, x = " ".join([*y[:-1], "end"]), " ".join(f"x{i}" for i in range(40))
    z = [f"z{i}" for i in range(60)]
    rows = [(3, " ".join(y)), (5, x), (5, y2), (-7, " ".join(z)), (-7, " ".join([*z[:-1], "end"])), (9, "a b c d e f g"), (9, "a b c d e f g"), (9, ""), (9, None), (11, x), (12, "one more text of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(df).collect()}
    assert {g[2:] for g in groups if g[:2] == (5, 36)} == {(5, True)} and {g[2:] for g in groups if g[:2] == (5, 56)} == {(3, False)}
    assert {g[2:] for g in groups if g[0] == 11} == {(5, False)} and [g[2] for g in groups if g[0] == -7] == [-7, -7]
    out = drop_near_copies(df)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and len(got) == len(set(got)) == 7
    assert set(got) - {g for g in got if g[0] == -7} == {(3, " ".join(y)), (5, x), (9, "a b c d e f g"), (9, ""), (9, None), (12, "one more text of its own here")}


def test_repeated_identifiers_equal_brute_force(spark):
    texts = [t for _, t in corpus(8, 6, 8)]
    rows = [(i // 3 * 5 - 20, t) for i, t in enumerate(random.Random(9).sample(texts, len(texts)))]
    want = brute(list(enumerate(t for _, t in rows)), 5)
    least = {}
    for at, (i, _) in enumerate(rows):
        least[want[at][1]] = min(i, least.get(want[at][1], i))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, want[at][0], least[want[at][1]]) for at, (i, _) in enumerate(rows))
    assert drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == len({w for _, w in want.values()})


def test_prefixes_by_broadcast_and_by_join_are_the_same(spark, monkeypatch):
    from variform.llm import minhash_dedup

    rows = corpus(5, 10, 12)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA)
    found = []
    for bound in (1 << 25, 0):
        monkeypatch.setattr(minhash_dedup, "BROADCAST_BYTES", bound)
        run = minhash_dedup.NearDuplicates(df, 2, 80, "doc_id", "text", 32, 5)
        members, hot = run.members()
        labels, _ = minhash_dedup.components(run.confirm(run.hub_pairs(members, hot)))
        pairs = {(r.u, r.v) for r in run.contested_pairs(members, hot, labels).collect()}
        found.append(pairs)
    assert found[0] == found[1]
