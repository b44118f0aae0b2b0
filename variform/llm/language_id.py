"""Language identification by compression.

For every language a raw-content zstandard dictionary is made from a bounded sample of its labelled texts: about
``SAMPLE_DOCS`` different texts, all of which enter. Where they exceed ``DICT_BYTES``, long ones give pieces from all over
the text, an equal share each. The whole text (letters and blanks, lower case) is compressed with each dictionary, and the
language whose dictionary gives the fewest bytes is chosen. One rule holds for all lengths: a text is compressed in
blocks, so that the dictionaries judge it and not its own beginning, and a tail of the dictionary is put behind every
block, so that a few matches count too (the format would else store the block as it is). A text is rejected when the
margin to the second language is narrow, or when it has no letter.

Defined results: null texts and texts without a letter are ``und``, rejected, with score 0; equal sizes go to the
language first in order, and are rejected; with one learned language everything with letters is that one, with none
everything is ``und``; repeated rows are judged alike, and repeated texts of a language learned once; an empty table
gives an empty result. Rows of a null language or a null text are never learned from. Columns of the input that are
called as those that are added are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, materialize, small_batches

UNDETERMINED = "und"
#: Bounds of the learned sample: rows a language, bytes of a dictionary, languages that get so much (with more, all get less).
SAMPLE_DOCS, DICT_BYTES, MAX_LANGUAGES = 400, 112 << 10, 200
#: Rows a language, and bytes of its dictionary, that any number of languages leaves it.
LEAST_DOCS, LEAST_BYTES = 20, 2048
#: A text longer than its share gives at most so many pieces.
PIECES = 8
BLOCK_BYTES, TAIL_BYTES, LEVEL = 4096, 256, 6
#: Least margin (second - best) / best for a decision.
MIN_MARGIN = 0.002
SHARPNESS = 60.0


class _Blanks(dict):
    """A translation table that is filled as characters are met: letters stay, the rest becomes a blank."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


_BLANKS = _Blanks()


def letters(text: str) -> str:
    """The words of a whole text in lower case, letters only."""
    return " ".join(unicodedata.normalize("NFC", text).lower().translate(_BLANKS).split())


class CompressionModel:
    """The dictionaries of the learned languages, by name."""

    def __init__(self, contents: dict[str, bytes]):
        self.contents = dict(sorted(contents.items()))
        self._ready = None

    def __getstate__(self):
        return self.contents

    def __setstate__(self, contents):
        self.contents, self._ready = contents, None

    def _compressors(self):
        if self._ready is None:
            import zstandard as z

            self._ready = []
            for content in self.contents.values():
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._ready.append((z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False), content[-TAIL_BYTES:]))
        return self._ready

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of a normalised text under every language."""
        raw = b" " + text.encode("utf-8") + b" "
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return np.array([sum(len(maker.compress(b + tail)) for b in blocks) for maker, tail in self._compressors()], dtype=float)

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether it is rejected."""
        text = letters(text or "")
        if not text or not self.contents:
            return UNDETERMINED, 0.0, 0.0, True
        size = self.sizes(text)
        best = int(size.argmin())
        rest = np.delete(size, best)
        margin = float((rest.min() - size[best]) / size[best]) if len(rest) else 1.0
        score = float(1.0 / np.exp(-SHARPNESS * (size - size[best]) / size[best]).sum())
        return list(self.contents)[best], score, margin, margin < min_margin or margin == 0


def fair_share(sizes: list[int], total: int) -> int:
    """The largest bound for every size with which their sum is at most total; what short ones leave goes to the long ones."""
    for i, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - i) > total:
            return max(2, total // (len(sizes) - i))
        total -= size
    return max(sizes, default=0)


def spread_pieces(text: bytes, share: int, pieces: int = PIECES) -> bytes:
    """At most share bytes of a normalised text, in whole words from up to ``pieces`` places all over it; of a longer word,
    its whole characters."""
    if len(text) <= share:
        return text
    pieces = max(1, min(pieces, share // 64))
    each, left, end, out = share // pieces, share, 0, []
    for k in range(pieces):
        at = max(end, k * (len(text) - each) // max(1, pieces - 1))
        if at and text[at - 1 : at] != b" ":
            at = text.find(b" ", at) + 1 or len(text)
        room = left // (pieces - k)
        piece = text[at : at + room]
        if text[at + room : at + room + 1] not in (b"", b" "):
            piece = piece.rpartition(b" ")[0]
        if piece:
            out.append(piece)
            left, end = left - len(piece) - 1, at + len(piece) + 1
    return b" ".join(out) or text[:share].decode("utf-8", "ignore").encode("utf-8")


def fit(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, max_languages: int = MAX_LANGUAGES,
) -> CompressionModel:
    """Learn dictionaries from about sample_docs different labelled texts a language, drawn by a hash of the text.

    Every language is learned; more than max_languages share the rows and bytes of so many. Texts are normalised and cut
    on the executors: the driver gets their sizes, then at most dict_bytes a language."""
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return CompressionModel({})
    if len(counts) > max_languages:
        sample_docs = min(sample_docs, max(LEAST_DOCS, sample_docs * max_languages // len(counts)))
        dict_bytes = min(dict_bytes, max(LEAST_BYTES, dict_bytes * max_languages // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 30))
    limit = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(int((1 << 30) * min(1.0, sample_docs / r[1]))))])
    # copies of a text are one: combined before they are shuffled
    drawn = rows.where(draw < limit[F.col("lang")]).groupBy("lang", "text").agg(F.count("*").alias("c")).select("lang", draw.alias("d"), "text")
    drawn, path = materialize(drawn, "drawn")
    small_batches(rows.sparkSession)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(letters(t.as_py()).encode("utf-8")) + 1 for t in b.column(2)], pa.int64())], names=["lang", "size"])

    found: dict[str, list[int]] = {}
    for lang, size in drawn.mapInArrow(sizes, "lang string, size long").collect():
        found.setdefault(lang, []).append(size)
    shares = {lang: fair_share(each, dict_bytes) - 1 for lang, each in found.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [spread_pieces(letters(t.as_py()).encode("utf-8"), shares[lang.as_py()]) for lang, t in zip(b.column(0), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["lang", "d", "piece"])

    pieces: dict[str, list[tuple[int, bytes]]] = {}
    for lang, d, piece in drawn.mapInArrow(cut, "lang string, d long, piece binary").collect():
        pieces.setdefault(lang, []).append((d, bytes(piece)))
    drop_path(rows.sparkSession, path)
    contents = {lang: b"".join(b" " + p for _, p in sorted(each) if p) for lang, each in pieces.items()}
    return CompressionModel({k: v for k, v in contents.items() if v.strip()})


def identify(docs: DataFrame, model: CompressionModel, text_col: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs (or its columns ``keep``) with lang_pred, score, margin and rejected; clashing columns are replaced."""
    added = ["lang_pred", "score", "margin", "rejected"]
    cols = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    src = docs.select(*cols, docs[text_col].alias("_lid_text"))
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*[src.schema[c] for c in cols], *[T.StructField(c, k) for c, k in zip(added, kinds, strict=True)]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py(), min_margin) for t in batch.column(len(cols))]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], *made], names=[*cols, *added])

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept back from learning: crc32 of the identifier's text; a null identifier counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(modulus)) == remainder
