"""The whole pipeline against a plain rendering of every stage."""

import math
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_minhash_dedup import brute as plain_groups

import corpus_pipeline as cp
from variform.llm import language_id
from variform.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_languages(spark, rows):
    """Predictions with the model that the stage learns; the model itself is held against held-out rows elsewhere."""
    model = language_id.fit(table(spark, SF, "documents"))
    found = {r["doc_id"]: model.predict(r["text"]) for r in rows}
    return [r | {"lang": found[r["doc_id"]][0]} for r in rows if not found[r["doc_id"]][3]]


def holds(text, items):
    """Whether a window of twice the longest item's words scores 0.6 of an item's own BM25 and has 0.8 of its shingles."""
    word = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bench = [w for w in map(word, items) if w]
    df = Counter(t for w in bench for t in set(w))
    mean, width, tokens = sum(map(len, bench)) / len(bench), max(map(len, bench)), word(text)

    def weight(t, w):
        tf = w.count(t)
        return math.log(1 + (len(bench) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    weights = [{t: weight(t, w) for t in set(w)} for w in bench]
    for at in range(0, max(1, len(tokens) - width), width):
        window = tokens[at : at + 2 * width]
        held, there = cut(window), set(window)
        for w, own in zip(bench, weights, strict=True):
            if sum(x for t, x in own.items() if t in there) >= 0.6 * sum(own.values()) and len(cut(w) & held) >= 0.8 * len(cut(w)):
                return True
    return False


def test_run_equals_a_plain_rendering(spark):
    rows = [r.asDict() for r in table(spark, SF, "documents").collect()]
    rows = plain_languages(spark, rows)
    cleaned = plain_lines([(r["doc_id"], r["text"]) for r in rows], 50)
    kept = []
    for r in rows:
        text, removed = cleaned[r["doc_id"]]
        if not removed or text.split():
            kept.append(r | {"text": text, "n_chars": len(text)})
    groups = plain_groups([(r["doc_id"], r["text"]) for r in kept], 5)
    kept = [r for r in kept if groups[r["doc_id"]][1] == r["doc_id"]]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    kept = [r for r in kept if not holds(r["text"], items)]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"], pieces.encode(r["text"])) for r in kept}
    got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars, list(r.ids)) for r in cp.run(spark, SF).collect()}
    assert got == want and 50 < len(want) < table(spark, SF, "documents").count()
