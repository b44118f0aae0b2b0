"""SentencePiece BPE by a prefix table of unique last tokens.

Byte-pair merging leaves, for every prefix of a text, exactly one possible last token. So instead of merging, one
walk over an Aho-Corasick automaton of the pieces fills a table: at each end position the candidates are the pieces
that end there, and the one that is compatible with the last token of the prefix before it is stored. The ids are
then read backwards from the end. Two neighbours are compatible when merging their joint text by itself never joins
across their border; this is decided from each piece's own merge history (``PieceMerges.compatible``).

Texts are cut where a piece can never reach across (a non-blank followed by the blank mark, checked against the
vocabulary), so equal words share one walk. Characters without a piece become their UTF-8 byte pieces.

Defined results: a null text counts as empty, which has no ids and decodes to the empty text; every row gives one
row, repeated rows included; an empty table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

MARK = "▁"  # stands for a blank
NORMAL, BYTE, UNKNOWN = 1, 6, 2
#: Words kept per Python worker; the table is emptied when full, so memory stays bounded.
CACHE_WORDS = 180_000
#: Words longer than this are encoded but not kept.
CACHE_CHARS = 64


class PieceMerges:
    """Merge histories of the pieces and the border test between neighbours."""

    def __init__(self, pieces: dict[str, int], score: list[float]):
        self.pieces, self.score = pieces, score
        self._edges: dict[str, tuple[list, list]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def _rank(self, text: str) -> float | None:
        i = self.pieces.get(text)
        return None if i is None else self.score[i]

    def _history(self, text: str) -> tuple[list, list]:
        """The piece's left-edge and right-edge symbols over time: [(score that must be reached, symbol), ...]."""
        known = self._edges.get(text)
        if known is not None:
            return known
        symbols = list(text)
        left, right = [(np.inf, symbols[0])], [(np.inf, symbols[-1])]
        need_left = need_right = np.inf
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self._rank(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            need_left, need_right = min(need_left, best), min(need_right, best)
            if at == 0:
                left.append((need_left, symbols[0]))
                need_left = np.inf
            if at == len(symbols) - 1:
                right.append((need_right, symbols[-1]))
                need_right = np.inf
        known = self._edges[text] = (left, right)
        return known

    def whole(self, text: str) -> bool:
        """Whether merging the piece's own text gives the piece back."""
        return self._history(text)[0][-1][1] == text

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b ends as exactly (a, b)."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        right, left = self._history(a)[1], self._history(b)[0]
        i = j = 0
        while True:
            across = self._rank(right[i][1] + left[j][1])
            next_a = right[i + 1][0] if i + 1 < len(right) else -np.inf
            next_b = left[j + 1][0] if j + 1 < len(left) else -np.inf
            # The higher score goes first; of equal ones the leftmost: a's, then the border, then b's.
            if across is not None and across > next_a and across >= next_b:
                return False
            if next_a == next_b == -np.inf:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1


class _Kept(dict):
    """ids of words, as bytes, encoded when they are first met."""

    def __init__(self, walk, prefix: str):
        super().__init__()
        self.walk, self.prefix = walk, prefix

    def __missing__(self, word: str) -> bytes:
        ids = np.asarray(self.walk(self.prefix + word), dtype=np.int32).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class SentencePieceBpe:
    """Encoder and decoder over the vocabulary of a SentencePiece BPE model file."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a BPE model without character normalisation is needed")
        norm = model.normalizer_spec
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that keeps blanks as prefix marks is needed")
        if set(p.type for p in model.pieces) - {1, 2, 3, 6} or not model.trainer_spec.byte_fallback:
            raise ValueError("only normal, unknown, control and byte pieces are supported, with byte fallback")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        self.surface = [p.piece if p.type == NORMAL else model.trainer_spec.unk_surface if p.type == UNKNOWN else "" for p in model.pieces]
        for i, b in list(self.byte_of.items()):
            if b < 0x80:  # a character by itself, whatever stands beside it
                self.surface[i] = chr(b)
                del self.byte_of[i]
        self.merges = PieceMerges(self.pieces, [p.score for p in model.pieces])
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            if self.merges.whole(piece):  # a piece that merging never forms can be no token
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        crossing = any(MARK in p.lstrip(MARK) for p in self.pieces)
        self._words = re.compile(r"(?s).+" if crossing else rf"{MARK}*[^{MARK}]+|{MARK}+")
        # lines can be cut apart where no piece holds a line feed
        self._by_line = self.dummy_prefix and not crossing and not any("\n" in p for p in self.pieces)
        self._feed = np.array([self.byte_ids[10]], dtype=np.int32).tobytes()
        self._marked, self._plain = _Kept(self._walk, MARK), _Kept(self._walk, "")

    def _walk(self, text: str) -> list[int]:
        """ids of a text: the table of last tokens, then the way back."""
        last: list[str] = [""] * (len(text) + 1)
        pieces, pairs, compatible = self.pieces, self.merges._pairs, self.merges.compatible
        filled = 0
        for end, piece in self.automaton.iter(text):
            while filled < end:  # where no piece ends, a character without a piece stands alone
                filled += 1
                last[filled] = last[filled] or text[filled - 1]
            if last[end + 1]:
                continue
            before = last[end + 1 - len(piece)]
            if before:
                fits = pairs.get((before, piece))
                if not (compatible(before, piece) if fits is None else fits):
                    continue
            last[end + 1] = piece
        for end in range(filled + 1, len(text) + 1):
            last[end] = last[end] or text[end - 1]
        out: list[int] = []
        end = len(text)
        while end:
            piece = last[end]
            i = pieces.get(piece)
            if i is None:
                out.extend([self.byte_ids[b] for b in reversed(piece.encode("utf-8"))])
            else:
                out.append(i)
            end -= len(piece)
        out.reverse()
        return out

    def _chunks(self, marked: str) -> list[bytes]:
        return [self._plain[w] for w in self._words.findall(marked)]

    def encode(self, text: str | None) -> np.ndarray:
        """ids of a whole text, without begin or end ids."""
        if not text:
            return np.empty(0, dtype=np.int32)
        if not self._by_line:
            return np.frombuffer(b"".join(self._chunks((" " + text if self.dummy_prefix else text).replace(" ", MARK))), dtype=np.int32)
        parts: list[bytes] = []
        marked = self._marked.__getitem__
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append(self._feed)
            if "  " in line or MARK in line or (k == 0 and line.startswith(" ")):
                # runs of marks are pieces of their own
                parts += self._chunks((" " + line if k == 0 else line).replace(" ", MARK))
                continue
            words = line.split(" ")
            if k:
                parts.append(self._plain[words[0]])
                del words[0]
            parts += map(marked, words)
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, the first blank of the dummy prefix dropped."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        surface, byte_of = self.surface, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            out: list[str] = []
            run = bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_utf8(run))
                    run.clear()
                out.append(surface[i])
            if run:
                out.append(_utf8(run))
            text = "".join(out)
        first = next((surface[i] for i in ids if surface[i] or i in byte_of), "")
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and first.startswith(MARK) else text


def _utf8(run: bytearray) -> str:
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):  # each byte of an invalid sequence becomes one replacement character
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + n]).decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_loaded: dict[str, SentencePieceBpe] = {}


def tokenizer(model_path: str) -> SentencePieceBpe:
    """The tokenizer of a model file, loaded once a Python worker."""
    if model_path not in _loaded:
        _loaded[model_path] = SentencePieceBpe(model_path)
    return _loaded[model_path]


def _slices(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text, so that long texts never pile up."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(
    docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, decoded_col: str | None = None
) -> DataFrame:
    """docs (or its columns ``keep``) with ids_col, array<int>: the ids of each whole text; and, if named, decoded_col:
    the text that decoding these ids gives, made in the same pass."""
    added = [ids_col, *([decoded_col] if decoded_col else [])]
    cols = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    src = docs.select(*cols, docs[text_col].alias("_spm_text"))
    kinds = [T.ArrayType(T.IntegerType(), False), T.StringType()]
    schema = T.StructType([*[src.schema[c] for c in cols], *[T.StructField(c, k, False) for c, k in zip(added, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spm = tokenizer(model_path)
        for whole in batches:
            for batch in _slices(whole, len(cols)):
                lists = [spm.encode(t.as_py()) for t in batch.column(len(cols))]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))]
                if decoded_col:
                    made.append(pa.array([spm.decode(x) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], *made], names=[*cols, *added])

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """tokens with text_col: the text of each array of ids (null ids count as empty)."""
    cols = [c for c in tokens.columns if c != text_col]
    at = cols.index(ids_col)
    kept = [c for c in cols if keep_ids or c != ids_col]
    schema = T.StructType([*[tokens.schema[c] for c in kept], T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spm = tokenizer(model_path)
        for batch in batches:
            column = batch.column(at)
            flat = column.values.to_numpy(zero_copy_only=False)
            offsets = column.offsets.to_numpy()
            texts = [spm.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            arrays = [batch.column(cols.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], names=[*kept, text_col])

    return tokens.select(*cols).mapInArrow(run, schema)


