"""INFO and the samples of body lines as typed Arrow arrays, a batch of lines at a time.

Only plain spellings are read here (whole numbers of up to nine digits, decimal numbers, calls of numbers and dots). A line that
has any other gives null, and the expressions of ``vcf.parse_records`` read it, or fail on it, as they do without this module."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from variform.sources.header import Field, VariantHeader

_WHOLE, _DECIMAL = r"^-?[0-9]{1,9}$", r"^-?[0-9]{1,15}(\.[0-9]{1,15})?([eE]-?[0-9]{1,2})?$"
_CALL = re.compile(r"[/|]?(\.|[0-9]{1,9})([/|](\.|[0-9]{1,9}))*")


def _picked(parts: pa.ListArray, place: int) -> pa.Array:
    """The element at a place of every list, null where the list is shorter."""
    offsets = parts.offsets.to_numpy()
    return parts.values.take(pa.array(offsets[:-1] + place, pa.int32(), mask=np.diff(offsets) <= place))


def _numbers(text: pa.Array, f: Field) -> tuple[pa.Array, np.ndarray]:
    if f.type not in ("Integer", "Float"):
        return text, np.zeros(len(text), bool)
    plain = pc.fill_null(pc.match_substring_regex(text, _WHOLE if f.type == "Integer" else _DECIMAL), True)
    text = pc.if_else(plain, text, pa.scalar(None, pa.string()))
    made = text.cast(pa.int32()) if f.type == "Integer" else text.cast(pa.float64()).cast(pa.float32(), safe=False)
    return made, ~plain.to_numpy(zero_copy_only=False)


def _typed(text: pa.Array, f: Field) -> tuple[pa.Array, np.ndarray]:
    """(values, which are spelled in another way) of a field's texts."""
    nothing = pa.scalar(None, pa.string())
    text = pc.if_else(pc.is_in(text, pa.array([".", ""])), nothing, text)
    if f.scalar:
        return _numbers(text, f)
    parts = pc.split_pattern(text, ",")
    values, odd = _numbers(pc.if_else(pc.equal(parts.values, "."), nothing, parts.values), f)
    odd_lists = np.zeros(len(text), bool)
    odd_lists[pc.list_parent_indices(parts).to_numpy()[odd]] = True
    return pa.ListArray.from_arrays(parts.offsets, values, mask=pc.is_null(parts)), odd_lists


def _call(text: str) -> dict | None:
    bare = text[1:] if text[0] in "/|" else text
    phased = [s == "|" for s in re.findall(r"[/|]", bare)]
    first = text[0] == "|" if bare is not text else phased[0] if phased else True
    return {"alleles": [None if a == "." else int(a) for a in re.split(r"[/|]", bare)], "phased": [first, *phased]}


def _calls(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every spelling of a batch is read once."""
    coded = text.dictionary_encode()
    spelled = coded.dictionary.to_pylist()
    odd = np.array([t != "" and not _CALL.fullmatch(t) for t in spelled], bool)
    kind = pa.struct([("alleles", pa.list_(pa.int32())), ("phased", pa.list_(pa.bool_()))])
    table = pa.array([None if t == "" or o else _call(t) for t, o in zip(spelled, odd, strict=True)], kind)
    at = coded.indices
    return table.take(at), pc.fill_null(pa.array(odd).take(at), False).to_numpy(zero_copy_only=False)


def samples_reader(header: VariantHeader) -> Callable[[pa.Array], pa.Array]:
    """Lines -> lists of the samples' structs."""
    n = len(header.samples)

    def block(texts: pa.Array, keys: list[str]) -> tuple[pa.Array, np.ndarray]:
        parts, fields, odd = pc.split_pattern(texts, ":"), [], np.zeros(len(texts), bool)
        for k, f in header.formats.items():
            text = _picked(parts, keys.index(k)) if k in keys else pa.nulls(len(texts), pa.string())
            values, other = _calls(text) if k == "GT" else _typed(text, f)
            fields.append(values)
            odd |= other
        return pa.StructArray.from_arrays(fields, names=list(header.formats)), odd.reshape(-1, n).any(axis=1)

    def run(lines: pa.Array) -> pa.Array:
        columns = pc.split_pattern(lines, "\t")
        offsets = columns.offsets.to_numpy()
        whole = np.flatnonzero(np.diff(offsets) >= 9 + n)
        starts = offsets[whole].astype(np.int64)
        formats = columns.values.take(pa.array(starts + 8)).dictionary_encode()
        codes, made, odd, order = formats.indices.to_numpy(zero_copy_only=False), [], [], []
        for code, keys in enumerate(formats.dictionary.to_pylist()):
            own = np.flatnonzero(codes == code)
            cells = (starts[own][:, None] + 9 + np.arange(n)).ravel()
            values, other = block(columns.values.take(pa.array(cells)), keys.split(":"))
            made.append(values)
            odd.append(other)
            order.append(whole[own])
        if not made:
            return None
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(whole) + 1, n), pa.int32()), pa.concat_arrays(made))
        place = np.full(len(lines), -1)
        place[np.concatenate(order)] = np.where(np.concatenate(odd), -1, np.arange(len(whole)))
        return lists if (place == np.arange(len(lines))).all() else lists.take(pa.array(place, mask=place < 0))

    return run


def info_reader(header: VariantHeader) -> Callable[[pa.Array], pa.Array]:
    """Texts of INFO -> structs."""

    def run(texts: pa.Array) -> pa.Array:
        parts = pc.split_pattern(texts, ";")
        rows = pc.list_parent_indices(parts).to_numpy()
        pairs = pc.split_pattern(parts.values, "=", max_splits=1)
        keys = _picked(pairs, 0).dictionary_encode()
        codes, names = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary.to_pylist()
        values = pc.fill_null(_picked(pairs, 1), "")
        odd = np.zeros(len(texts), bool)
        # a repeated key
        places = rows * max(len(names), 1) + codes
        seen, counts = np.unique(places, return_counts=True)
        odd[seen[counts > 1] // max(len(names), 1)] = True
        fields = []
        for k, f in header.infos.items():
            at = np.full(len(texts), -1, np.int64)
            if k in names:
                own = np.flatnonzero(codes == names.index(k))
                at[rows[own]] = own
            if f.type == "Flag":
                fields.append(pa.array(at >= 0))
                continue
            made, other = _typed(values.take(pa.array(at, mask=at < 0)), f)
            fields.append(made)
            odd |= other
        return pa.StructArray.from_arrays(fields, names=list(header.infos), mask=pa.array(odd | pc.is_null(texts).to_numpy(zero_copy_only=False)))

    return run


def column(kind: pa.DataType, reader: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """The reader with results of the type that Spark expects."""

    def run(texts: pa.Array) -> pa.Array:
        made = reader(texts)
        return pa.nulls(len(texts), kind) if made is None else made.cast(kind)

    return run
