"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, line_dedup, minhash_dedup, pii, sentencepiece_bpe, token_counts, toxicity, url_filter
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, by the start rule."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with two-word shingle similarity of 0.8 or more."""
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _day(days: Column) -> Column:
    """Midnight, so many days after 2024-01-01."""
    return F.timestamp_seconds(F.lit(1704067200) + days.cast("long") * 86400)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of day page_id % 365, against a list log derived from the pages' own hosts."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", _day(F.col("page_id") % 365).alias("fetched_at"))
    on_host = pages.select(url_filter.host(F.col("url")).alias("h"), F.regexp_extract("url", "^[^:]+://[^/]+/([a-z]+)/", 1).alias("seg")).where("h != ''")
    digit = lambda i: F.ascii(F.substring(F.md5(F.col("h").cast("binary")), i, 1))
    hosts = on_host.select("h").distinct().where(digit(1) <= 54)
    paths = on_host.where("seg != ''").select(F.concat_ws("/", "h", "seg").alias("h")).distinct().where(digit(1) <= 50)
    listed = hosts.unionByName(paths)
    blocks = listed.select(F.col("h").alias("pattern"), F.lit("block").alias("action"), _day(digit(2) * 2).alias("at"))
    allows = listed.where(digit(4) <= 55).select(F.col("h").alias("pattern"), F.lit("allow").alias("action"), _day(digit(2) * 2 + digit(3)).alias("at"))
    domain = spark.sql("SELECT 'example.net' AS pattern, action, d FROM VALUES ('block', 40), ('allow', 70), ('block', 300) AS t(action, d)")
    entries = blocks.unionByName(allows).unionByName(domain.select("pattern", "action", _day(F.col("d")).alias("at")))
    out = url_filter.filter_urls(captures, entries)
    since = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_timestamp("valid_from") / 86400).cast("int")).cast("string")
    return out.select("page_id", "blocked", "matched_pattern", since.alias("valid_from"), "n_matches")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), model, keep=["doc_id"], decoded_col="text")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of line runs of 50 words or more."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language_id.held_out("doc_id", 3, 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out)), keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < len(pii.BASE_KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document holds the item's text."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_near_dedup, op3_exact_dedup, op4_url_filters, op5_sentencepiece, op6_language_id, op7_line_dedup, op8_toxicity, op9_pii, op10_decontaminate)
}

ORACLE: dict[str, str] = {
    # All pairs by their shared shingles, then reachability over the links.
    "op2_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
        held AS (SELECT doc_id, unnest(s) AS g FROM sets),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN ways ON b = x)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op3_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
              FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))""",
    "op4_url_filters": r"""
        WITH cap AS (
            SELECT page_id, page_id % 365 AS day, url,
                   rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS h,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)/', 1) AS seg
            FROM pages),
        listed AS (
            SELECT DISTINCT h AS p FROM cap WHERE h != '' AND ascii(substr(md5(h), 1, 1)) <= 54
            UNION ALL SELECT DISTINCT h || '/' || seg FROM cap WHERE h != '' AND seg != '' AND ascii(substr(md5(h || '/' || seg), 1, 1)) <= 50),
        entries AS (
            SELECT p, 'block' AS action, ascii(substr(md5(p), 2, 1)) * 2 AS d FROM listed
            UNION ALL SELECT p, 'allow', ascii(substr(md5(p), 2, 1)) * 2 + ascii(substr(md5(p), 3, 1)) FROM listed WHERE ascii(substr(md5(p), 4, 1)) <= 55
            UNION ALL SELECT * FROM (VALUES ('example.net', 'block', 40), ('example.net', 'allow', 70), ('example.net', 'block', 300))),
        spans AS (
            SELECT p, d AS d0, (SELECT min(e.d) FROM entries e WHERE e.p = b.p AND e.action = 'allow' AND e.d > b.d) AS d1
            FROM entries b WHERE action = 'block'),
        hits AS (
            SELECT page_id, p, d0 FROM cap, spans
            WHERE (h = p OR (h || rtrim(path, '/') || '/') LIKE p || '/%' OR h LIKE '%.' || p) AND day >= d0 AND (d1 IS NULL OR day < d1) AND h != ''),
        best AS (
            SELECT page_id, count(*) AS n, arg_min(p, lpad(CAST(1000 - length(p) AS VARCHAR), 4, '0') || p) AS p,
                   arg_min(d0, lpad(CAST(1000 - length(p) AS VARCHAR), 4, '0') || p) AS d0
            FROM hits GROUP BY page_id)
        SELECT cap.page_id, best.p IS NOT NULL AS blocked, best.p AS matched_pattern,
               strftime(DATE '2024-01-01' + CAST(best.d0 AS INTEGER), '%Y-%m-%d') AS valid_from, coalesce(n, 0) AS n_matches
        FROM cap LEFT JOIN best USING (page_id)""",
    # A run counts if a window of it does that has 50 words at least and is the shortest from its start or to its end.
    "op7_line_dedup": r"""
        WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS line FROM docs),
        n AS (SELECT doc_id, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
        c AS (SELECT doc_id, pos, w, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS cw FROM n),
        win AS (
            SELECT 1 AS kind, a.doc_id, a.pos AS s, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos
            WHERE b.cw - a.cw + a.w >= 50 AND b.cw - b.w - a.cw + a.w < 50
            UNION ALL
            SELECT 2, a.doc_id, a.pos, b.pos FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos
            WHERE b.cw - a.cw + a.w >= 50 AND b.cw - a.cw < 50),
        keyed AS (SELECT kind, doc_id, s, e, array_to_string(list_slice(ls, s + 1, e + 1), chr(10)) AS k FROM win JOIN docs USING (doc_id)),
        later AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY kind, k ORDER BY doc_id, s) AS r FROM keyed),
        gone AS (SELECT DISTINCT doc_id, CAST(unnest(range(s, e + 1)) AS INTEGER) AS pos FROM later WHERE r > 1),
        kept AS (
            SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text,
                   count(*) AS n_lines, count(gone.pos) AS n_removed
            FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
        SELECT d.doc_id, kept.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN kept USING (doc_id)""",
}
