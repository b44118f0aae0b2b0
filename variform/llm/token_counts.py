"""Token counts by offset-mapped attribution.

Each whole document is encoded once. Its tokens get character spans from their byte lengths (a token that starts or
ends inside a character reaches over that whole character), and the spans are joined as intervals to the document's
sections, so that any number of sections costs one encoding. A token that crosses a section's border is allocated by
an explicit rule:

  start     the section that holds the token's first character counts it whole
  end       the section that holds its last character counts it whole
  split     every section counts the fraction of the token's characters that it holds

Sections are the lines of the text (each with its line feed), or the intervals of a column
array<struct<section, start, end>> (end exclusive; they may overlap, leave gaps or reach past the text, in which case
the rule is applied to each by itself).

Defined results: a null text counts as empty; an empty text has one empty line with no tokens; a null or empty list
of sections gives no row for that document; repeated rows are counted separately; an empty table gives an empty
result; the other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

RULES = ("start", "end", "split")


class RankedBpe:
    """A tiktoken encoding of a rank file, with the byte length of every token."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and one past the last character of every token."""
        ids = self.encoding.encode_ordinary(text)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = text.encode("utf-8")
        if len(raw) != len(text):
            upto = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, out=upto[1:])
            starts, ends = upto[starts + 1] - 1, upto[ends]
        return starts, ends


_loaded: dict[tuple[str, str], RankedBpe] = {}


def ranked_bpe(ranks_path: str, pattern: str) -> RankedBpe:
    """The encoding of a rank file, loaded once a Python worker."""
    key = (ranks_path, pattern)
    if key not in _loaded:
        _loaded[key] = RankedBpe(*key)
    return _loaded[key]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every line; a line holds its line feed."""
    lengths = np.array([len(line) + 1 for line in text.split("\n")], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    ends[-1] -= 1
    return starts, ends


def allocate(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [lo, hi), the tokens being sorted by start (and end)."""
    hi = np.maximum(lo, hi)
    if rule == "start":
        return (np.searchsorted(starts, hi, "left") - np.searchsorted(starts, lo, "left")).astype(float)
    if rule == "end":
        return (np.searchsorted(ends, hi, "right") - np.searchsorted(ends, lo, "right")).astype(float)

    def upto(x: np.ndarray) -> np.ndarray:
        whole = np.searchsorted(ends, x, "right")  # tokens that end at x or before
        total = whole.astype(float)
        width = np.concatenate([[0.0], np.cumsum(1.0 / (ends - starts))]) if len(starts) else np.zeros(1)
        begun = np.searchsorted(starts, x, "left")
        # of the tokens begun but not ended, each gives (x - start) / width
        part = np.concatenate([[0.0], np.cumsum(starts / (ends - starts))]) if len(starts) else np.zeros(1)
        begun = np.maximum(begun, whole)
        return total + x * (width[begun] - width[whole]) - (part[begun] - part[whole])

    return np.round(upto(hi) - upto(lo), 6)


def count_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start",
) -> DataFrame:
    """Per document and section: the identifier, section, start, end (characters), n_tokens (double) and doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"), *([docs[sections_col].alias("_sections")] if sections_col else []))
    schema = T.StructType([
        src.schema[id_col], T.StructField("section", T.StringType() if sections_col else T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("n_tokens", T.DoubleType()), T.StructField("doc_tokens", T.LongType()),
    ])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranked_bpe(ranks_path, pattern)
        for batch in batches:
            section, lo_all, hi_all, counts, totals, repeats = [], [], [], [], [], []
            given = batch.column(2).to_pylist() if sections_col else None
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                starts, ends = bpe.spans(text)
                if given is None:
                    lo, hi = line_sections(text)
                    section.append(np.arange(len(lo)))
                else:
                    rows = [s for s in given[i] or [] if s is not None and s["start"] is not None and s["end"] is not None]
                    lo, hi = (np.array([s[k] for s in rows], dtype=np.int64) for k in ("start", "end"))
                    section.append(np.array([s["section"] for s in rows], dtype=object))
                lo_all.append(lo)
                hi_all.append(hi)
                counts.append(allocate(starts, ends, lo, hi, rule))
                totals.append(len(starts))
                repeats.append(len(lo))
            if not repeats:
                continue
            take = np.repeat(np.arange(batch.num_rows), repeats)
            names_of = np.concatenate(section)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(take)), pa.array(names_of, pa.string() if sections_col else pa.int64()), pa.array(np.concatenate(lo_all)),
                pa.array(np.concatenate(hi_all)), pa.array(np.concatenate(counts)), pa.array(np.repeat(np.array(totals, dtype=np.int64), repeats)),
            ], names=names)

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)
