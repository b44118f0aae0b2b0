import random

from variform.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, n_lines string, gone int"


def brute(rows, least):
    """Positions in the longest runs that also stand earlier, if they have so many words."""
    docs = sorted((i, t.split("\n")) for i, t in rows if t is not None)
    places = [(i, p) for i, ls in docs for p in range(len(ls))]
    lines = dict(docs)
    out = {}
    for i, ls in docs:
        gone = set()
        for p in range(len(ls)):
            longest = 0
            for j, q in places:
                if (j, q) >= (i, p):
                    break
                n = 0
                while p + n < len(ls) and q + n < len(lines[j]) and ls[p + n] == lines[j][q + n]:
                    n += 1
                longest = max(longest, n)
            if sum(len(x.split()) for x in ls[p : p + longest]) >= least:
                gone |= set(range(p, p + longest))
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone))
    return out


def test_equals_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(f"t{r.randrange(9)}" for _ in range(r.randint(0, 4))) for _ in range(9)]
    rows = []
    for i in range(60):
        text = [r.choice(pool) if r.random() < 0.8 else f"own {i} {k}" for k in range(r.randint(0, 25))]
        if rows and r.random() < 0.5:
            other = r.choice(rows)[1].split("\n")
            at = r.randrange(len(other))
            text += other[at : at + r.randint(1, 12)]
        rows.append((i, "\n".join(text)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {x.doc_id: (x.text, x.n_removed) for x in dedup_lines(df, min_words=8).collect()}
    assert got == brute(rows, 8)


def test_nulls_repeats_long_texts_and_empty(spark):
    para = " ".join(f"word{i}" for i in range(60))
    rows = [(1, para, "a", 1), (2, para + "\ntail", "b", 2), (2, para + "\ntail", "b", 2), (3, None, "c", 3), (None, para, "d", 4), (4, "", "e", 5), (5, "\n".join(["x y"] * 3000), "f", 6)]
    got = sorted(((r.doc_id or 0), r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id != 3)
    long = [g for g in got if g[0] == 5][0]
    assert [g for g in got if g[0] not in (5,)] == [(0, para, 0), (1, para, 0), (2, "tail", 1), (2, "tail", 1), (4, "", 0)]
    assert long[2] == 2999 and long[1] == "x y"
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
