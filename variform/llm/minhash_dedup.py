"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its word shingles (64-bit hashes). Equal sets are one node, so copies cost nothing more.
``bands`` x ``rows`` MinHash samples of each node give one key a band; nodes that share a key are candidates. The
samples are also folded into an odd sketch: every sample flips one bit of a parity bitmap, so the population count of
two bitmaps' XOR estimates how many samples differ, most precisely where few do. Candidates whose estimate is far
below the threshold are dropped; all others are confirmed on the full sets.

A bucket's pairs are never listed. Each bucket's hub (the member whose buckets are the largest, as the common origin
of a group of copies is) is paired with every member, which takes one row a member. Confirmed links are joined to
components. Only the members of buckets that then still hold several components are looked at again, by a search that
leaves out no link between their components: every set's shingles are put in one order, rarest first; two
linked sets share a shingle among the first of both, and where it stands bounds what they can share in all. Shingles
whose holders all have one component are dropped, and holders of a shingle's largest component are only met by others.
These pairs are confirmed on the full sets without the sketches. Buckets, hubs, star centres and shingles that very
many rows have are dealt over many tasks (salted joins).

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. Two nodes at the threshold are missed by all bands
with a chance of (1 - s**rows)**bands: 3e-6 at 0.8 with 32 x 5. A linked pair of a hub is dropped by the sketches if its
estimate is SLACK too low, over five standard errors: under 1e-6.

Defined results: null texts and texts without words have no shingles and are linked with nothing; a text with fewer
words than a shingle has its whole sequence as one; rows that repeat an identifier are one node for each set of
shingles, and each is kept or dropped by its own set; of rows that repeat both, all are marked alike and
``drop_near_copies`` keeps one; a row with a null identifier is alone, with a null component, and kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, BitFilter, drop_path, hot_keys, is_hot, materialize, salted_join, small_batches

BANDS, ROWS = 32, 5
SKETCH_BITS = 512
#: How far below the threshold an odd-sketch estimate must be to drop a candidate (over five standard errors).
SLACK = 0.25
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # odd mixing constants
WORD_CACHE = 60_000
#: More than the sets that can share their smallest identifier.
NUMBERS = 1 << 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, filled as they are met and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.zeros(0, dtype=np.uint64)
    get = _words.__getitem__
    h = np.fromiter(map(get, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = _mix((out ^ h[i : i + n]) * _C1 + np.uint64(i))
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes | None:
    """128-bit hash of a set of shingles, None if it is empty."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


class Signer:
    """MinHash band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS):
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.default_rng(20240229)
        size = bands * rows
        self.a = rng.integers(0, 1 << 64, size, dtype=np.uint64, endpoint=False) | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, size, dtype=np.uint64, endpoint=False)
        self.fold = rng.integers(0, 1 << 64, size, dtype=np.uint64, endpoint=False) | np.uint64(1)
        self.offset = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _C1)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(shingles), 512):
            part = shingles[i : i + 512, None] * self.a
            part += self.b
            np.minimum(least, part.min(axis=0), out=least)
        return least

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and the sketch as 64-bit words."""
        mixed = _mix(self.samples(shingles) ^ self.fold)
        keys = _mix((mixed.reshape(self.bands, self.rows) * self.fold[: self.rows]).sum(axis=1, dtype=np.uint64) + self.offset)
        parity = np.bincount((mixed >> np.uint64(20)) % np.uint64(self.bits), minlength=self.bits) & 1
        return keys.view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n (set size), set_id (128-bit hash of the set, null if empty), keys and sketch per row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([
        src.schema["id"], T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("keys", longs), T.StructField("sketch", longs),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in batches:
            n, set_ids, keys, sketches = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                set_ids.append(set_digest(s))
                if len(s):
                    key, sketch = signer.sign(s)
                else:
                    key = sketch = np.zeros(0, dtype=np.int64)
                keys.append(key)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(set_ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "n", "set_id", "keys", "sketch"],
            )

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


def odd_estimate(a: Column, b: Column, samples: int, bits: int = SKETCH_BITS) -> Column:
    """Similarity from two odd sketches: differing samples = -bits/2 ln(1 - 2z/bits), each difference counted twice."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    inside = F.greatest(F.lit(1.0) - z * 2.0 / bits, F.lit(1e-3))
    return F.lit(1.0) + F.lit(bits / 4.0 / samples) * F.log(inside)


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) of every node of edges (u, v), and its path: label is the smallest node reachable. Alternating large
    and small stars; the edges of a star's centre are dealt over many tasks if they are very many."""
    current, path = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        n = 2 * current.count()
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c")), "least")
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        large = salted_join(both.where("v > u"), least.select("u", "m"), ["u"], hot_keys(least, ["u"], n), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large, large_path = materialize(large.unionByName(least.where("m != u").select("u", F.col("m").alias("v"))).distinct(), "large")
        # small star: every smaller neighbour, and the node itself, is linked to the smallest of them
        low, low_path = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "low")
        small = salted_join(large, low.select("u", "m"), ["u"], hot_keys(low, ["u"], n), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after, after_path = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (path, least_path, large_path, low_path):
            drop_path(edges.sparkSession, old)
        current, path = after, after_path
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    made = materialize(current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "labels")
    drop_path(edges.sparkSession, path)
    return made


class NearDuplicates:
    """The stages of one run over a table of documents."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, bands: int, rows: int):
        self.docs, self.k, self.percent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, percent
        self.samples, self.paths = bands * rows, []
        self.signed, _ = materialize(signatures(docs, k, id_col, text_col, bands, rows), "signed")
        filled = self.signed.where("n > 0 AND id IS NOT NULL")
        self.repeated, _ = materialize(filled.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "repeated")
        #: Whether identifiers repeat; only then are nodes more than the smallest identifier of a set.
        self.numbered = not self.repeated.isEmpty()
        nodes = filled.groupBy("set_id").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
        )
        if self.numbered:
            # sets of one smallest identifier are numbered: identifier * NUMBERS + number, in the identifiers' order
            number = F.row_number().over(Window.partitionBy("node").orderBy("set_id")) - 1
            wide = F.col("node").cast("decimal(20,0)") * F.lit(NUMBERS).cast("decimal(10,0)") + F.col("_k").cast("decimal(10,0)")
            nodes = nodes.withColumn("_k", number).withColumn("node", wide.cast("decimal(38,0)")).drop("_k")
        self.nodes, _ = materialize(nodes, "nodes")

    def id_of(self, node: Column) -> Column:
        """The smallest identifier of a node's set."""
        if not self.numbered:
            return node
        least = node - F.pmod(node, F.lit(NUMBERS).cast("decimal(38,0)"))
        return (least / F.lit(NUMBERS).cast("decimal(10,0)")).cast(self.docs.schema["id"].dataType)

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that goes when the labels are known."""
        made, path = materialize(df, name)
        self.paths.append(path)
        return made

    def members(self) -> tuple[DataFrame, dict[int, int]]:
        """(key, node, n, size) of all buckets with two nodes or more, and the keys that very many have."""
        rows = self.nodes.select("node", "n", F.explode("keys").alias("key"))
        shared = self.scratch(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        hot = hot_keys(shared, ["key"], shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], "size")
        return self.scratch(salted_join(rows, shared, ["key"], hot, ["node"]), "members"), hot

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, from their texts."""
        wanted = self.scratch(wanted.select("node").distinct(), "wanted")
        if self.numbered:
            return self.numbered_sets(wanted)
        n = wanted.count()
        maybe = BitFilter(wanted.select(F.xxhash64("node").alias("h")), "h", n).keep(self.docs.where("id IS NOT NULL"), F.xxhash64("id"))
        texts = maybe.join(wanted.withColumnRenamed("node", "id"), "id", "left_semi")
        kind = T.StructType([T.StructField("node", texts.schema["id"].dataType), T.StructField("shingles", T.ArrayType(T.LongType(), False))])
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [shingle_set(t.as_py(), k).view(np.int64) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

        return self.scratch(texts.select("id", "text").mapInArrow(run, kind), "sets")

    def numbered_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes where identifiers repeat: the text is the one with the node's set."""
        nodes = self.nodes.join(wanted, "node").select("node", self.id_of(F.col("node")).alias("id"), "set_id")
        texts = self.docs.join(nodes, "id")
        kind = T.StructType([T.StructField("node", nodes.schema["node"].dataType), T.StructField("shingles", T.ArrayType(T.LongType(), False))])
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [shingle_set(t.as_py(), k) for t in b.column(1)]
                own = pa.array([set_digest(s) == x.as_py() for s, x in zip(made, b.column(2), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], names=["node", "shingles"])
                yield out.filter(own)

        return self.scratch(texts.select("node", "text", "set_id").mapInArrow(run, kind).dropDuplicates(["node"]), "sets")

    def confirm(self, pairs: DataFrame, sketched: bool = True) -> DataFrame:
        """The pairs (u, v) at or above the threshold; sketched: drop those first whose odd-sketch estimate is far below.

        The node of a pair that has more pairs (a hub) comes last, so that its set is not shuffled for each of them."""
        pairs = self.scratch(pairs, "pairs")
        n = pairs.count()
        degree = self.scratch(pairs.select(F.col("u").alias("x")).unionByName(pairs.select(F.col("v").alias("x"))).groupBy("x").agg(F.count("*").alias("c")), "degree")
        hot = hot_keys(degree, ["x"], n)
        named = lambda df, x, **cols: df.select(F.col("node").alias(x), *[F.col(c).alias(k) for k, c in cols.items()])
        # a pair of two hot nodes may stand either way
        hub = is_hot(hot, "u")
        turned = pairs.select(F.when(hub, F.col("v")).otherwise(F.col("u")).alias("m"), F.when(hub, F.col("u")).otherwise(F.col("v")).alias("h"))
        near = turned
        if sketched:
            near = salted_join(near, named(self.nodes, "m", sm="sketch"), ["m"], hot, ["h"])
            near = salted_join(near, named(self.nodes, "h", sh="sketch"), ["h"], hot, ["m"])
            near = near.where(odd_estimate(F.col("sm"), F.col("sh"), self.samples) >= self.percent / 100 - SLACK).select("m", "h")
        near = self.scratch(near, "near")
        sets = self.sets(near.select(F.col("m").alias("node")).unionByName(near.select(F.col("h").alias("node"))))
        full = salted_join(near, named(sets, "m", a="shingles"), ["m"], hot, ["h"])
        full = salted_join(full, named(sets, "h", b="shingles"), ["h"], hot, ["m"])
        both = F.size(F.array_intersect("a", "b"))
        # 100 * both >= percent * (|a| + |b| - both)
        links = full.where(both * (100 + self.percent) >= (F.size("a") + F.size("b")) * self.percent)
        return self.scratch(links.select(F.greatest("m", "h").alias("u"), F.least("m", "h").alias("v")), "links")

    def hub_pairs(self, members: DataFrame, hot: dict[int, int]) -> DataFrame:
        """Every member with the hub of its bucket."""
        weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
        hubs = members.select("key", "node").join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("o"))).alias("h"))
        pairs = salted_join(members.select("key", "node"), hubs.select("key", (-F.col("h.o")).alias("hub")), ["key"], hot, ["node"]).where("node != hub")
        return pairs.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()

    def contested_pairs(self, members: DataFrame, hot: dict[int, int], labels: DataFrame) -> DataFrame:
        """The pairs between components, of nodes in buckets of three or more that hold several, that can be links.

        With shingles in one order, rarest first, a link's first shared shingle at places i and j (from 0) leaves at most
        1 + min(|a| - 1 - i, |b| - 1 - j) shared ones."""
        p = self.percent
        rows = self.scratch(members.where("size > 2").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")), "labelled")
        split = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key")
        nodes = self.scratch(salted_join(rows, split, ["key"], hot, ["node"]).select("node", "n", "label").distinct(), "contested")
        sets = self.sets(nodes)
        shingles = sets.select("node", F.explode("shingles").alias("h"))
        common = self.scratch(shingles.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common")
        n_common, n = common.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        if 16 * n_common <= BROADCAST_BYTES:
            first = self.prefixes(sets.join(nodes, "node"), common)
        else:
            held = salted_join(shingles, common, ["h"], hot_keys(common, ["h"], n, "df"), ["node"]).join(nodes, "node")
            # shingles of one holder come first in the order; they need no rows
            w = Window.partitionBy("node")
            first = held.select(
                "node", "n", "label", "h", (F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "h")) - 1).cast("long").alias("i")
            ).where((F.col("n") - F.col("i")) * 100 >= F.col("n") * p)
        first = self.scratch(first, "first")
        largest = first.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("k"), F.sum("c").alias("c")).where("k > 1")
        largest = self.scratch(largest.drop("k"), "largest")
        wide = hot_keys(largest, ["h"], largest.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
        mixed = self.scratch(salted_join(first, largest.drop("c"), ["h"], wide, ["node"]), "mixed")
        side = lambda s, df: df.select("h", *[F.col(c).alias(c + s) for c in ("node", "n", "label", "i")])
        a, b = side("_a", mixed.where("label != most")), side("_b", mixed)
        shared = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
        pairs = salted_join(a, b, ["h"], wide, ["node_a"]).where((F.col("label_a") != F.col("label_b")) & (shared * (100 + p) >= (F.col("n_a") + F.col("n_b")) * p))
        return pairs.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v")).distinct()

    def prefixes(self, sets: DataFrame, common: DataFrame) -> DataFrame:
        """(node, n, label, h, i) of the first shingles of sets (node, shingles, n, label) that others hold too: i is their place
        among the set's, rarest first. common (h, df) is broadcast, its size is checked before."""
        table = common.orderBy("h").toArrow()
        shared = sets.sparkSession.sparkContext.broadcast((table["h"].to_numpy(), table["df"].to_numpy()))
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, counts = shared.value
            for b in batches:
                of, hs, places = [], [], []
                for row, shingles in enumerate(b.column(3)):
                    h = shingles.values.to_numpy()
                    if not len(known) or not len(h):
                        continue
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    df = np.where(known[at] == h, counts[at], 1)
                    order = np.lexsort((h, df))
                    i = np.arange(len(h))
                    kept = ((len(h) - i) * 100 >= len(h) * percent) & (df[order] > 1)
                    of.append(np.full(int(kept.sum()), row))
                    hs.append(h[order][kept])
                    places.append(i[kept])
                if of:
                    rows = pa.array(np.concatenate(of))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(3)), pa.array(np.concatenate(hs), pa.int64()), pa.array(np.concatenate(places), pa.int64())], names=["node", "n", "label", "h", "i"])

        longs = [T.StructField(c, T.LongType()) for c in ("h", "i")]
        return sets.select("node", "n", "label", "shingles").mapInArrow(run, T.StructType([*[sets.schema[c] for c in ("node", "n", "label")], *longs]))

    def labels(self) -> DataFrame:
        """(node, label) of all linked nodes."""
        members, hot = self.members()
        links = self.confirm(self.hub_pairs(members, hot))
        labels, path = components(links)
        more = self.confirm(self.contested_pairs(members, hot, labels), sketched=False)
        if not more.isEmpty():
            first, old = labels, path
            labels, _ = components(first.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))
            drop_path(first.sparkSession, old)
        for path in self.paths:
            drop_path(self.nodes.sparkSession, path)
        return labels


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (smallest identifier reachable over links) and kept (is it that one?).

    Two documents are linked when 100 * |A and B| >= percent * |A or B|; fewer bands miss more, for a lower percent
    more bands or fewer rows are needed. Identifiers are integers."""
    out = _marked(NearDuplicates(docs, shingle_words, percent, id_col, text_col, bands, rows))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _marked(run: NearDuplicates) -> DataFrame:
    """id, n, set_id, component_id and kept of every row."""
    label = F.coalesce("label", "node")
    of_set = run.nodes.select("set_id", "node").join(run.labels(), "node", "left").select(
        "set_id", run.id_of(label).alias("component_id"), (label == F.col("node")).alias("root")
    )
    out = run.signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("set_id")).alias("set_id")).join(of_set, "set_id", "left")
    component = F.coalesce("component_id", "id")
    kept = component.eqNullSafe(F.col("id")) & F.coalesce("root", F.lit(True))
    return out.select("id", "n", "set_id", component.alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one of the smallest identifier; all columns stay."""
    run = NearDuplicates(docs, shingle_words, percent, id_col, text_col, BANDS, ROWS)
    gone = _marked(run).where("NOT kept")
    if not run.numbered:
        return docs.join(gone.select(F.col("id").alias(id_col)), id_col, "left_anti")
    # rows of a repeated identifier are told apart by their sets
    gone, _ = materialize(gone.select(F.col("id").alias(id_col), F.col("set_id").alias("_set")), "gone")
    repeated = run.repeated.select(F.col("id").alias(id_col))
    once = docs.join(repeated, id_col, "left_anti").join(gone, id_col, "left_anti")

    @F.pandas_udf(T.BinaryType())
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([set_digest(shingle_set(t, shingle_words)) for t in texts], dtype=object)

    several, _ = materialize(docs.join(repeated, id_col, "left_semi").withColumn("_set", digest(text_col)), "several")
    filled = several.where("_set IS NOT NULL").join(gone, [id_col, "_set"], "left_anti").dropDuplicates([id_col, "_set"])
    return once.unionByName(filled.unionByName(several.where("_set IS NULL")).select(*docs.columns)).select(*docs.columns)
