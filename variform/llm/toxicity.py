"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its terms, hashed into buckets: its lower-cased words, their first four letters, and the words
and beginnings (three to five letters) that make up a share of the text (``DENSE_SHARE`` of its words, twice at least),
as abuse comes in compounds and is repeated. Besides a weight, every kept bucket has a small factor vector, so the model
adds w_i of each term and <v_i, v_j> of each pair that occurs together: pairs such as an insult and a group mention
score higher than the sum of their parts.

The model is fitted on a bounded sample of labelled rows (``sample_docs``), drawn by a hash of the identifier. A bucket
that at least ``min_docs`` sample rows have is kept if it tells the labels apart by itself (by ``min_z`` standard
errors), or together with another one: the residuals of the weights alone are searched for pairs by power iteration on
the matrix of all pairs (which is never built), so that terms that are harmless singly are not lost, while chance words
never score. Where the labels are drawn at different rates, the bias is corrected to what all rows would give, so that
scores mean the same at every size.

Defined results: null and empty texts get the score of a document without terms; rows whose label is null are not
learned from; of rows that repeat an identifier one text is learned from; without a learned row of both labels the
score is the share of toxic ones (0 if none); repeated rows are scored alike; an empty table gives an empty result; a
column of the input that is called as the score is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, drop_path, materialize, small_batches

#: Bounds of the learned sample, and of the model.
SAMPLE_DOCS, HASH_BITS, FACTORS = 12_000, 30, 8
MIN_DOCS, MIN_Z = 6, 4.5
#: Standard errors of a pair that is kept, loadings of a factor that are looked at, and rounds of the power iteration.
PAIR_Z, LOADINGS, ROUNDS = 6.0, 32, 15
DENSE_SHARE = 1 / 128
_WORD = re.compile(r"[^\W_]+")


def buckets(text: str | None, bits: int = HASH_BITS) -> np.ndarray:
    """The set of hashed terms of a whole text."""
    counts = Counter(_WORD.findall((text or "").lower()))
    terms = set(counts)
    terms |= {"^" + w[:4] for w in counts}
    least = max(2, DENSE_SHARE * counts.total())
    terms |= {"=" + w for w, c in counts.items() if c >= least}
    for size in (3, 4, 5):
        stems: Counter[str] = Counter()
        for w, c in counts.items():
            stems[w[:size]] += c
        terms |= {f"#{size}{w}" for w, c in stems.items() if c >= least}
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8")) & mask for w in terms), dtype=np.int32, count=len(terms)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def significant_pairs(rows: list[np.ndarray], n: int, error: np.ndarray, min_docs: int, factors: int, pair_z: float = PAIR_Z) -> np.ndarray:
    """Of the terms 0..n-1, those in a pair whose documents' errors sum to pair_z standard errors.

    rows: terms of each document; error: what a model without pairs leaves of its label. The pairs' matrix X'diag(error)X
    (X centred, terms by their spread) is only multiplied; its leading vectors name the terms whose pairs are tested."""
    if not n or not len(rows):
        return np.zeros(0, dtype=np.int64)
    ids, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.bincount(ids, minlength=n) / len(rows)
    scale = 1 / np.sqrt(np.maximum(share * (1 - share), 1e-9) * len(rows))
    times = lambda v: np.bincount(doc, (scale * v)[ids], len(rows)) - (share * scale * v).sum()
    back = lambda u: scale * (np.bincount(ids, u[doc], n) - share * u.sum())
    vectors = np.linalg.qr(np.random.default_rng(3).normal(size=(n, min(factors, n))))[0]
    looked: set[int] = set()
    for _ in range(ROUNDS):
        vectors = np.linalg.qr(np.column_stack([back(error * times(v)) for v in vectors.T]))[0]
        for v in vectors.T:
            looked.update(np.argsort(-np.abs(v))[:LOADINGS].tolist())
    terms = np.array(sorted(looked))
    place = np.full(n, -1)
    place[terms] = np.arange(len(terms))
    held = np.zeros((len(rows), len(terms)))
    known = place[ids] >= 0
    held[doc[known], place[ids[known]]] = 1.0
    both = held.T @ held
    # of a pair's documents, what their errors sum to beyond what either term alone explains
    alone = (held * error[:, None]).sum(0) / np.maximum(held.sum(0), 1)
    total = held.T @ (held * error[:, None]) - both * (alone[:, None] + alone[None, :])
    z = total / np.sqrt(np.maximum(held.T @ (held * (error**2)[:, None]), 1e-9))
    z[(both < min_docs) | np.eye(len(terms), dtype=bool)] = 0.0
    return terms[(np.abs(z) >= pair_z).any(axis=1)]


class FactorizationMachine:
    """Second-order factorization machine over sets of buckets."""

    def __init__(self, bits: int = HASH_BITS, factors: int = FACTORS, seed: int = 7):
        self.bits, self.factors, self.seed = bits, factors, seed
        self.bias = -30.0
        self.kept = np.zeros(0, dtype=np.int64)
        self.w = np.zeros(0)
        self.v = np.zeros((0, factors))

    def known(self, terms: np.ndarray) -> np.ndarray:
        """Positions of the kept buckets among terms."""
        if not len(self.kept):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.kept, terms), len(self.kept) - 1)
        return at[self.kept[at] == terms]

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, epochs: int = 40, rate: float = 0.3, l2: float = 1e-6, batch: int = 256, rates: tuple[float, float] = (1.0, 1.0)) -> FactorizationMachine:
        """rates: at which rows of label 0 and of label 1 were drawn."""
        rng = np.random.default_rng(self.seed)
        share = float(labels.mean()) if len(labels) else 0.0
        if share in (0.0, 1.0):
            self.bias = 30.0 if share else -30.0
            return self
        terms, back, seen = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
        toxic = np.bincount(back, np.repeat(labels, [len(d) for d in docs]), len(terms))
        n1, n0 = labels.sum(), (1 - labels).sum()
        p = seen / len(labels)
        z = (toxic / n1 - (seen - toxic) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        common = seen >= min_docs
        single, error = common & (np.abs(z) >= min_z), labels - share
        for k in range(2):
            # first what single terms tell, then the pairs that this leaves
            self.kept = terms[single]
            if k:
                self.kept = np.union1d(self.kept, terms[common][significant_pairs([at[at >= 0] for at in self._places(docs, terms[common])], int(common.sum()), error, min_docs, self.factors)])
            rows = [self.known(d) for d in docs]
            self._descend(rows, labels, share, rng, epochs if k else epochs // 2, rate, l2, batch, pairs=bool(k))
            error = labels - _sigmoid(np.array([self._sum(r) for r in rows]))
        # the weights take half of the log-odds of the labels' share out of the fit; the other half is the sample's
        self.bias -= 0.5 * float(np.log(rates[1] / rates[0]))
        return self

    @staticmethod
    def _places(docs: list[np.ndarray], kept: np.ndarray) -> Iterator[np.ndarray]:
        """Of each document, the places of its terms in kept, -1 for others."""
        for d in docs:
            at = np.minimum(np.searchsorted(kept, d), len(kept) - 1)
            yield np.where(kept[at] == d, at, -1) if len(kept) else np.zeros(0, dtype=np.int64)

    def _descend(self, rows: list[np.ndarray], labels: np.ndarray, share: float, rng, epochs: int, rate: float, l2: float, batch: int, pairs: bool) -> None:
        """Adaptive gradient descent over the kept buckets."""
        n = len(self.kept)
        self.bias = float(np.log(share / (1 - share)))
        self.w, self.v = np.zeros(n), rng.normal(0, 0.01, (n, self.factors)) * pairs
        gw, gv, gb = np.full(n, 1e-8), np.full((n, self.factors), 1e-8), 1e-8
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                ids = np.concatenate([rows[i] for i in at])
                doc = np.repeat(np.arange(len(at)), [len(rows[i]) for i in at])
                total = np.zeros((len(at), self.factors))
                np.add.at(total, doc, self.v[ids])
                square = np.bincount(doc, (self.v[ids] ** 2).sum(1), len(at))
                z = self.bias + np.bincount(doc, self.w[ids], len(at)) + 0.5 * ((total**2).sum(1) - square)
                err = (_sigmoid(z) - labels[at]) * weight[at] / len(at)
                used, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, err[doc], len(used)) + l2 * self.w[used]
                dv = np.zeros((len(used), self.factors))
                np.add.at(dv, back, err[doc, None] * (total[doc] - self.v[ids]))
                dv += l2 * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += err.sum() ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                if pairs:
                    self.v[used] -= rate / 4 * dv / np.sqrt(gv[used])
                self.bias -= rate * err.sum() / np.sqrt(gb)

    def _sum(self, ids: np.ndarray) -> float:
        v = self.v[ids]
        return self.bias + self.w[ids].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())

    def score(self, terms: np.ndarray) -> float:
        """Probability of label 1 for a set of buckets."""
        return float(_sigmoid(np.array(self._sum(self.known(terms)))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> FactorizationMachine:
    """Fit on about sample_docs of the rows of labels (half of them toxic, if there are so many) that docs has.

    Terms are made, and those in fewer than MIN_DOCS rows left out, on the executors; the driver gets the rest."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    counts = dict(known.groupBy("y").count().collect())
    draw = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30))
    part = lambda y: max(1, int((1 << 30) * min(1.0, sample_docs / 2 / max(1, counts.get(y, 0)))))
    drawn = known.where(draw < F.when(F.col("y") == 1, part(1)).otherwise(part(0)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # about sample_docs different pairs of numbers; of rows that repeat an identifier the one of the least hash
    sample = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([buckets(t.as_py()) for t in b.column(2)], pa.list_(pa.int32()))], names=["id", "y", "terms"]
            )

    fields = [T.StructField("id", sample.schema["id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType()))]
    small_batches(docs.sparkSession)
    rows, path = materialize(sample.select("id", "y", "text").mapInArrow(terms, T.StructType(fields)), "terms")
    each = rows.select("id", "y", F.explode("terms").alias("term"))
    common = each.groupBy("term").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_DOCS).select("term")
    if 16 * common.count() <= BROADCAST_BYTES:
        common = F.broadcast(common)
    kept = each.join(common, "term").groupBy("id", "y").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    got = rows.select("id", "y").join(kept, ["id", "y"], "left").toArrow()
    drop_path(docs.sparkSession, path)
    order = sorted(range(got.num_rows), key=lambda i: (str(got["id"][i]), got["y"][i].as_py()))
    sets = [np.array(got["terms"][i].as_py() or [], dtype=np.int64) for i in order]
    return FactorizationMachine().fit(sets, np.array([got["y"][i].as_py() for i in order], dtype=float), rates=(part(0) / (1 << 30), part(1) / (1 << 30)))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with score_col, the probability of label 1."""
    cols = [c for c in (keep if keep is not None else docs.columns) if c != score_col]
    src = docs.select(*cols, docs[text_col].alias("_tox_text"))
    schema = T.StructType([*[src.schema[c] for c in cols], T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [m.score(buckets(t.as_py(), m.bits)) for t in b.column(len(cols))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(scores, pa.float64())], names=[*cols, score_col])

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)
