import datetime as dt

import numpy as np
import public_tokenizers

from variform.llm import url_filter
from variform.llm.token_counts import RankedBpe, allocate, count_tokens, line_sections
from variform.llm.url_filter import filter_urls, validity_intervals

DAY = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_list_entries_hold_at_fetch_time(spark):
    log = [("spam.com", "block", 5), ("spam.com", "allow", 10), ("spam.com", "block", 20), ("A.org/x", "block", 0), ("same.net", "block", 3), ("same.net", "allow", 3), (None, "block", 1), ("n.com", None, 1)]
    entries = spark.createDataFrame([(p, a, DAY(d)) for p, a, d in log], "pattern string, action string, at timestamp")
    assert validity_intervals(entries).count() == 4
    urls = [
        ("http://a.spam.com/q", 4, False), ("http://a.spam.com/q", 5, True), ("http://a.spam.com/q", 9, True), ("http://SPAM.com:80/", 10, False), ("http://u@spam.com", 25, True),
        ("http://notspam.com/", 25, False), ("http://a.org/x/y?z", 1, True), ("http://a.org/xy", 1, False), ("http://b.a.org/x", 1, False), ("http://same.net.", 4, True), (None, 4, False), ("junk", 4, False),
    ]
    rows = [(i, u, DAY(d), "c") for i, (u, d, _) in enumerate(urls)] + [(99, "http://spam.com", None, "c"), (100, "http://spam.com/", DAY(6), "c"), (100, "http://spam.com/", DAY(6), "c")]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, blocked string"), entries).collect()
    assert {r.page_id: r.blocked for r in got if r.page_id < 99} == {i: b for i, (*_, b) in enumerate(urls)}
    assert [r.blocked for r in got if r.page_id == 99] == [False] and [r.blocked for r in got if r.page_id == 100] == [True, True]
    empty = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp, blocked string")
    assert filter_urls(empty, entries).count() == 0
    assert not any(r.blocked for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, blocked string"), entries.limit(0)).collect())


def test_any_column_names_long_urls_and_hot_captures(spark):
    entries = spark.createDataFrame([("spam.com/" + "p" * 3000, "block", DAY(0)), ("spam.com", "block", DAY(5))], "pattern string, action string, at timestamp")
    long = "http://spam.com/" + "p" * 3000 + "/" + "q" * 50_000
    rows = [(1, long, DAY(1), "m", "a", "n")] + [(2, "http://x.spam.com/", DAY(6), "m", "a", "n")] * 300 + [(3, None, DAY(6), "m", "a", "n")] * 100
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, m string, _at string, n string")
    for bound in (1 << 25, 0):  # the broadcast, and the join beyond it
        old, url_filter.BROADCAST_BYTES = url_filter.BROADCAST_BYTES, bound
        got = filter_urls(df, entries).collect()
        url_filter.BROADCAST_BYTES = old
        assert sorted((r.page_id, r.blocked, r.n_matches, r.m, r["_at"], r.n) for r in got) == [(1, True, 1, "m", "a", "n")] + [(2, True, 1, "m", "a", "n")] * 300 + [(3, False, 0, "m", "a", "n")] * 100


TEXTS = ["", "one line", "a\n\nb\n", "héllo 日本語 😀😀\nwörld  \n\n  x", "😀" * 500 + "\n" + "y" * 20_000, None]


def owner(spans, lo, hi, rule):
    if rule == "split":
        return sum(max(0, min(e, hi) - max(s, lo)) / (e - s) for s, e in spans)
    return sum(lo <= (s if rule == "start" else e - 1) < hi for s, e in spans)


def test_allocation_equals_brute_force():
    bpe = RankedBpe(RANKS, public_tokenizers.PATTERN)
    for text in TEXTS[:5]:
        starts, ends = bpe.spans(text)
        tokens, at, raw = bpe.encoding.encode_ordinary(text), 0, text.encode()
        for k, t in enumerate(tokens):
            n = len(bpe.encoding.decode_single_token_bytes(t))
            assert starts[k] == len(raw[: at + 1].decode(errors="ignore") + " ") - 1 - (raw[at] < 0x80 or len(raw[: at + 1].decode(errors="ignore")) > len(raw[:at].decode(errors="ignore"))) or starts[k] <= len(raw[:at].decode(errors="ignore"))
            at += n
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        lo, hi = line_sections(text)
        assert "".join(text[a:b] for a, b in zip(lo, hi, strict=True)) == text
        for rule in ("start", "end", "split"):
            want = [owner(spans, a, b, rule) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            assert np.allclose(allocate(starts, ends, lo, hi, rule), want, atol=1e-4), (text[:20], rule)


def test_rows_and_given_sections(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, section string")
    rows = count_tokens(df, RANKS, public_tokenizers.PATTERN).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for rs in by_doc.values():
        assert sum(r.n_tokens for r in rs) == rs[0].doc_tokens
    assert len(by_doc[5]) == 1 and by_doc[5][0].doc_tokens == 0
    fields = spark.createDataFrame([(1, "title body text", [("title", 0, 5), ("all", 0, 99)]), (2, "x", None), (3, "x", [])], "doc_id long, text string, f array<struct<section:string,start:int,end:int>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in count_tokens(fields, RANKS, public_tokenizers.PATTERN, sections_col="f", rule="split").collect()}
    assert got[(1, "all")] >= got[(1, "title")] > 0 and set(got) == {(1, "title"), (1, "all")}
    assert count_tokens(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
