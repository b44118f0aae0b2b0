import random

import public_tokenizers
import sentencepiece

from variform.llm.sentencepiece_bpe import SentencePieceBpe, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", " ", "  ", "the", "ing", "\n", "▁", "é", "日本", "😀", "<0x0A>", "\0", "\t", "tion", "12", "Ñ", "xxxxx", "</s>", "<s>", "ا", " т", "ов", "​"]


def test_ids_and_texts_equal_the_library():
    ours, theirs = SentencePieceBpe(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    texts = ["", " ", "▁", "a" * 30_000, " " * 5_000, "日本" * 5_000] + ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for text in texts:
        ids = ours.encode(text).tolist()
        assert ids == theirs.encode(text), text[:50]
        assert ours.decode(ids) == theirs.decode(ids), text[:50]
    for _ in range(2000):
        ids = [r.randrange(3, 600) for _ in range(r.randint(0, 10))]
        assert ours.decode(ids) == theirs.decode(ids), ids


def test_operator_on_rows(spark):
    df = spark.createDataFrame([(1, "hello  world", "x"), (2, None, "y"), (2, None, "y"), (3, "", None)], "doc_id long, text string, ids string")
    out = encode(df, MODEL, decoded_col="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id, r.decoded) for r in out.collect()) == [(1, "hello  world"), (2, ""), (2, ""), (3, "")]
    assert sorted(r.text for r in decode(encode(df, MODEL, keep=["doc_id"]), MODEL).collect()) == ["", "", "", "hello  world"]
    assert encode(df.limit(0), MODEL).count() == 0
