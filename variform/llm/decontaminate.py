"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage.

The items are indexed once: each term has a posting list in item order, cut into blocks with their largest impact.
Impacts are BM25 term weights divided by the item's score for its own text, so that every item is reached at the
same threshold, a share of its own score. All passages of all documents are queries: a passage is a window of twice
the longest item's words, and windows overlap by half, so every copy of an item lies whole in one of them. Block-max
WAND retrieves every item at or above the threshold: a window for which no block's largest impacts sum to it is
skipped without touching a list, and in the lists blocks that cannot reach it are jumped over. Nothing is capped.

Retrieved items are verified: the share of the question's word shingles (five words; a shorter question is one
shingle) that the passage holds must reach ``min_overlap``, and the answer, where an item has one, must stand in the
passage as a word sequence.

The items are a test set: they are read in slices of at most ``slice_bytes`` of text, one at a time, and each slice is
one broadcast and one pass, written before the next is built.
Document frequencies, item count, mean and longest length are those of all items, so slices do not change a score.

Defined results: a null or empty text holds no item; items without words are never found; equal items are all
reported; a null item identifier is reported as null; repeated documents are judged alike; with an empty table of
documents or items nothing is found; very long texts are searched whole; a ``matches`` column of the input is replaced
by ``find_items`` and stays in ``drop_contaminated``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, fresh, materialize, small_batches

_WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Items in a block: at least so many, and at most so many blocks in a list.
LEAST_BLOCK, MOST_BLOCKS = 8, 32
SHINGLE, MIN_OVERLAP, THRESHOLD = 5, 0.8, 0.6
SLICE_BYTES = 64 << 20


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(tokens: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} if tokens else set()


class ItemStats:
    """What BM25 takes from all items: in how many a term is, their number, their words and the longest one's."""

    def __init__(self):
        self.df: Counter[str] = Counter()
        self.n = self.words = self.longest = 0

    def add(self, tokens: list[str]) -> None:
        if tokens:
            self.df.update(set(tokens))
            self.n, self.words, self.longest = self.n + 1, self.words + len(tokens), max(self.longest, len(tokens))


class Bm25Index:
    """Inverted index of items [(id, question, answer or None), ...] with block-max impacts; stats: of all items, if these
    are a slice."""

    def __init__(self, items: list[tuple], stats: ItemStats | None = None):
        tokens = [words(q) + words(a) for _, q, a in items]
        kept = [i for i, t in enumerate(tokens) if t]
        self.items = [items[i] for i in kept]
        tokens = [tokens[i] for i in kept]
        self.block = block = max(LEAST_BLOCK, -(-len(kept) // MOST_BLOCKS))
        self.questions = [shingles(words(q)) for _, q, _ in self.items]
        self.answers = [words(a) for _, _, a in self.items]
        if stats is None:
            stats = ItemStats()
            for t in tokens:
                stats.add(t)
        self.longest = stats.longest
        mean = stats.words / max(1, stats.n)
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, toks in enumerate(tokens):
            for term in dict.fromkeys(toks):
                tf = toks.count(term)
                postings.setdefault(term, []).append((i, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(toks) / mean))))
        n = len(tokens)
        own = [0.0] * n
        for term, plist in postings.items():
            idf = math.log(1 + (stats.n - stats.df[term] + 0.5) / (stats.df[term] + 0.5))
            plist[:] = [(i, idf * x) for i, x in plist]
            for i, x in plist:
                own[i] += x
        self.terms = {t: k for k, t in enumerate(postings)}
        self.lists = [([i for i, _ in p], [x / own[i] for i, x in p]) for p in postings.values()]
        # blocks are cut by item number, alike in all lists: largest[t, k] is the largest impact of term t on items of block k
        self.largest = np.zeros((len(self.lists), max(1, -(-n // block))), dtype=np.float32)
        for t, (ids, xs) in enumerate(self.lists):
            np.maximum.at(self.largest[t], np.array(ids) // block, np.array(xs, dtype=np.float32))
        self.by_block = self.largest.tolist()
        self.most = np.array([max(xs) for _, xs in self.lists] or [0.0])

    def wand(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold for a query of distinct terms.

        Blocks whose largest impacts do not sum to the threshold are never entered; in the others, items are reached
        in order by pivots whose block impacts do."""
        found, slack = [], threshold - 1e-9
        bounds = self.largest[query].sum(axis=0) if query else np.zeros(0)
        for k in np.flatnonzero(bounds >= threshold - 1e-4).tolist():
            end = min((k + 1) * self.block, len(self.items))
            cursors = [[0, 0, t, bound] for t in query if (bound := self.by_block[t][k]) > 0]  # item, place, term, bound
            for c in cursors:
                self._seek(c, k * self.block)
            while True:
                cursors = [c for c in cursors if c[0] < end]
                cursors.sort()
                bound, pivot = 1e-6, -1
                for i, c in enumerate(cursors):
                    bound += c[3]
                    if bound >= slack:
                        pivot = i
                        break
                if pivot < 0:
                    break
                item = cursors[pivot][0]
                score = 0.0
                for c in cursors:
                    if c[0] < item:
                        self._seek(c, item)
                    if c[0] == item:
                        score += self.lists[c[2]][1][c[1]]
                        self._seek(c, item + 1)
                if score >= slack:
                    found.append((item, score))
        return found

    def _seek(self, cursor: list, item: int) -> None:
        ids = self.lists[cursor[2]][0]
        at = bisect_left(ids, item, cursor[1])
        cursor[1], cursor[0] = at, ids[at] if at < len(ids) else len(self.items)

    def search(self, text: str | None, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> dict[int, tuple[float, float]]:
        """item -> (score, overlap), the best over all passages of a whole text."""
        tokens = words(text)
        best: dict[int, tuple[float, float]] = {}
        if not tokens or not self.items:
            return best
        get = self.terms.get
        ids = np.array([get(w, -1) for w in tokens], dtype=np.int64)
        # windows are pairs of neighbouring segments of as many words as the longest item
        width, n = self.longest, len(self.lists)
        places = np.flatnonzero(ids >= 0)
        if not len(places):
            return best
        keys = np.unique(places // width * n + ids[places])
        segment, term = keys // n, keys % n
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        sums = np.zeros((max(2, -(-len(tokens) // width)), self.largest.shape[1]), dtype=np.float32)
        sums[segment[first]] = np.add.reduceat(self.largest[term], first)
        for w in np.flatnonzero((sums[:-1] + sums[1:]).max(axis=1) >= threshold - 1e-4).tolist():
            s, e = w * width, (w + 2) * width
            query = np.unique(ids[s:e])
            query = query[query >= 0]
            if self.largest[query].sum(axis=0).max() < threshold - 1e-4:
                continue
            retrieved = self.wand(query.tolist(), threshold)
            if not retrieved:
                continue
            held = shingles(tokens[s:e])
            line = " " + " ".join(tokens[s:e]) + " "
            for item, score in retrieved:
                question = self.questions[item]
                if question and len(min(question, key=len)) < SHINGLE:
                    overlap = float(" " + " ".join(next(iter(question))) + " " in line)
                else:
                    overlap = len(question & held) / len(question) if question else 1.0
                answer = self.answers[item]
                if overlap < min_overlap or (answer and " " + " ".join(answer) + " " not in line):
                    continue
                best[item] = max(best.get(item, (0.0, 0.0)), (score, overlap))
        return best


class ItemSlices:
    """Indexes over all items, one after the other, each of at most about slice_bytes of text: the driver holds one."""

    def __init__(self, items: DataFrame, id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, slice_bytes: int = SLICE_BYTES):
        self.picked = items.select(F.col(id_col), F.col(question_col), F.col(answer_col) if answer_col else F.lit(None).cast("string"))
        self.slice_bytes, self.stats, self.count, self.only = slice_bytes, ItemStats(), 0, None
        for held in self._rows():
            self.count += 1
            self.only = held if self.count == 1 else None
            for _, q, a in held:
                self.stats.add(words(q) + words(a))

    def _rows(self) -> Iterator[list[tuple]]:
        rows, size = [], 0
        for r in self.picked.toLocalIterator():
            rows.append(tuple(r))
            size += len(r[1] or "") + len(r[2] or "")
            if size >= self.slice_bytes:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[Bm25Index]:
        for rows in [self.only] if self.only is not None else self._rows():
            yield Bm25Index(rows, self.stats)


def build_slices(items: DataFrame, id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, slice_bytes: int = SLICE_BYTES) -> ItemSlices:
    return ItemSlices(items, id_col, question_col, answer_col, slice_bytes)


def find_items(docs: DataFrame, index: Bm25Index, id_type: T.DataType, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP, column: str = "matches") -> DataFrame:
    """docs (or its columns ``keep``) with ``column``, array<struct<item_id, score, overlap>> in item order."""
    cols = [c for c in (keep if keep is not None else docs.columns) if c != column]
    src = docs.select(*cols, docs[text_col].alias("_dec_text"))
    kind = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("score", T.DoubleType()), T.StructField("overlap", T.DoubleType())]))
    schema = T.StructType([*[src.schema[c] for c in cols], T.StructField(column, kind)])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ix, arrow = shared.value, to_arrow_type(kind)
        for b in batches:
            made = []
            for text in b.column(len(cols)):
                best = ix.search(text.as_py(), threshold, min_overlap)
                made.append([{"item_id": ix.items[i][0], "score": round(s, 6), "overlap": round(o, 6)} for i, (s, o) in sorted(best.items())])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(made, arrow)], names=[*cols, column])

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, slice_bytes: int = SLICE_BYTES, **limits) -> DataFrame:
    """One row per document and item that it holds: id_col, item_id, score, overlap."""
    slices, out = build_slices(items, item_col, question_col, answer_col, slice_bytes), None
    kind = items.schema[item_col].dataType
    for index in slices or [Bm25Index([])]:
        rows = find_items(docs, index, kind, text_col, keep=[id_col], **limits).select(id_col, F.inline("matches"))
        if len(slices) > 1:
            # written before the next slice is built, so that one index at a time is broadcast
            rows, _ = materialize(rows, "matches")
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, slice_bytes: int = SLICE_BYTES, **limits) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, whatever their names."""
    slices, path, spark = build_slices(items, item_col, question_col, answer_col, slice_bytes), None, docs.sparkSession
    columns, mark = docs.columns, fresh("matches", docs.columns)
    for k, index in enumerate(slices):
        found = find_items(docs, index, items.schema[item_col].dataType, text_col, column=mark, **limits)
        docs = found.where(F.size(mark) == 0).select(*columns)
        if k < len(slices) - 1:
            old = path
            docs, path = materialize(docs, "clean")
            if old:
                drop_path(spark, old)
    return docs
