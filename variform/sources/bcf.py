"""BCF in and out: typed values to and from the rows of the data model. Records cannot be found from the middle of a file, so
one task cuts a file into chunks of records, and many decode them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from variform.sources import bgzf
from variform.sources.header import Field, VariantHeader, parse_map
from variform.sources.vcf import _first_file, _magic, commit_blocks, refuse_own_input

MAGIC = b"BCF\x02\x02"
# Type codes with their element type, missing value and end-of-vector mark.
INTS = {1: ("<i1", -128, -127), 2: ("<i2", -32768, -32767), 3: ("<i4", -2147483648, -2147483647)}
FLOAT, CHAR = 5, 7
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002
CHUNK = 1 << 20


def dictionary(text: str) -> tuple[list[str], list[str]]:
    """Names by number of a header's FILTER, INFO and FORMAT definitions, and of its contigs; IDX decides where it is given."""
    strings, contigs = {0: "PASS"}, {}
    for line in text.split("\n"):
        m = re.match(r"##(FILTER|INFO|FORMAT|contig)=(<.*>)\s*$", line)
        if not m:
            continue
        fields, table = parse_map(m[2]), contigs if m[1] == "contig" else strings
        if fields.get("ID") in table.values():
            continue
        table[int(fields["IDX"]) if "IDX" in fields else max(table, default=-1) + 1] = fields["ID"]
    listed = lambda t: [t.get(i, "") for i in range(max(t, default=-1) + 1)]
    return listed(strings), listed(contigs)


# ---------------------------------------------------------------- decoding

class _Bytes:
    """Typed values one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def kind(self) -> tuple[int, int]:
        """Type code and number of elements."""
        byte = self.data[self.at]
        self.at += 1
        size = byte >> 4
        return byte & 15, self.integers(*self.kind())[0] if size == 15 else size

    def integers(self, code: int, n: int) -> list:
        dtype, missing, end = INTS[code]
        values = np.frombuffer(self.data, dtype, n, self.at).tolist()
        self.at += n * int(dtype[-1])
        return [None if v == missing else v for v in values if v != end]

    def values(self, code: int, n: int):
        """A list of numbers (None: missing), or a text."""
        if code == CHAR:
            raw = self.data[self.at : self.at + n]
            self.at += n
            return raw.rstrip(b"\0").decode("utf-8")
        if code == FLOAT:
            bits = np.frombuffer(self.data, "<u4", n, self.at)
            self.at += 4 * n
            return [None if b == FLOAT_MISSING else float(v) for b, v in zip(bits.tolist(), bits.view("<f4"), strict=True) if b != FLOAT_END]
        return [] if code == 0 else self.integers(code, n)

    def one(self):
        return self.values(*self.kind())


def _typed(value, f: Field):
    """A decoded value as the field's type has it."""
    if f.type == "Flag":
        return True
    if isinstance(value, str):
        parts = [None if v == "." else v for v in value.split(",")] if value not in ("", ".") else []
        return (None if value in ("", ".") else value) if f.scalar else parts or None
    if f.type == "Float":
        value = [None if v is None else float(v) for v in value]
    if f.scalar:
        return value[0] if value else None
    return value if value and value != [None] else None


def _call(values: list) -> dict | None:
    """A genotype of coded alleles; the first is phased as the second is."""
    if not values:
        return None
    phased = [bool(v & 1) for v in values]
    return {"alleles": [(v >> 1) - 1 if v >> 1 else None for v in values], "phased": [phased[1] if len(phased) > 1 else True, *phased[1:]]}


class Decoder:
    """Rows of the data model from records' bytes."""

    def __init__(self, header: VariantHeader, text: str):
        self.header = header
        self.strings, self.contigs = dictionary(text)
        self.place = {c: i for i, c in enumerate(header.contigs)}

    def record(self, row_id: int, shared: bytes, own: bytes) -> dict:
        h = self.header
        chrom, pos, _, qual, counts, samples = struct.unpack_from("<iiiIII", shared)
        n_info, n_alleles, n_samples, n_formats = counts & 0xFFFF, counts >> 16, samples & 0xFFFFFF, samples >> 24
        if n_samples != len(h.samples):
            raise ValueError(f"record {row_id} has {n_samples} samples, its header {len(h.samples)}")
        data = _Bytes(shared[24:])
        ids = data.one()
        alleles = [data.one() for _ in range(n_alleles)]
        filters = [self.strings[i] for i in data.one()]
        info = dict.fromkeys(h.infos)
        for k, f in h.infos.items():
            if f.type == "Flag":
                info[k] = False
        for _ in range(n_info):
            key = self.strings[data.one()[0]]
            value = data.one()
            if key in h.infos:
                info[key] = _typed(value, h.infos[key])
        rows = [dict.fromkeys(h.formats) for _ in range(n_samples)]
        data = _Bytes(own)
        for _ in range(n_formats):
            key = self.strings[data.one()[0]]
            code, n = data.kind()
            for row in rows:
                value = data.values(code, n)
                if key in h.formats:
                    row[key] = _call(value) if key == "GT" else _typed(value, h.formats[key])
        name = self.contigs[chrom]
        out = {
            "row_id": row_id, "contig_idx": self.place.get(name), "chrom": name, "pos": pos + 1, "ids": [] if ids in ("", ".") else ids.split(";"), "ref": alleles[0], "alts": alleles[1:],
            "qual": None if qual == FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", qual))[0], "filters": filters,
        }
        return out | ({"info": info} if h.infos else {}) | ({"samples": rows} if h.formats else {})

    def chunk(self, first: int, data: bytes) -> Iterator[dict]:
        at = 0
        while at < len(data):
            shared, own = struct.unpack_from("<II", data, at)
            at += 8
            yield self.record(first, data[at : at + shared], data[at + shared : at + shared + own])
            at, first = at + shared + own, first + 1


def _stream(system, place: str, size: int, zipped: bool) -> Iterator[bytes]:
    with system.open_input_file(place) as f:
        if zipped:
            yield from (payload for _, payload in bgzf.payloads(f, 0, size, size))
        else:
            while got := f.read(CHUNK):
                yield got


def _take(held: bytearray, chunks: Iterator[bytes], n: int) -> bool:
    """Whether held has n bytes, after reading as many chunks as that needs."""
    while len(held) < n:
        more = next(chunks, None)
        if more is None:
            return False
        held += more
    return True


def read_bcf_header(spark: SparkSession, path: str) -> str:
    """The header's text: only the first blocks are read."""
    fs, p, size = _first_file(spark, path)
    from pyarrow import fs as arrow_fs

    system, place = arrow_fs.FileSystem.from_uri(p.toString())
    chunks, held = _stream(system, place, size, _magic(spark, path, 2) == b"\x1f\x8b"), bytearray()
    if not _take(held, chunks, 9) or bytes(held[:5]) != MAGIC:
        raise ValueError(f"{path} is no BCF")
    n, = struct.unpack_from("<I", held, 5)
    if not _take(held, chunks, 9 + n):
        raise ValueError(f"{path} ends in its header")
    return bytes(held[9 : 9 + n]).rstrip(b"\0").decode("utf-8")


def read_bcf(spark: SparkSession, path: str, tasks: int | None = None) -> tuple[DataFrame, VariantHeader]:
    """(rows, header) of a BCF file, BGZF or raw; row_id follows the file's order. One task cuts the file, ``tasks`` decode it."""
    text = read_bcf_header(spark, path)
    header = VariantHeader.parse(text)
    fs, p, size = _first_file(spark, path)
    uri, zipped = p.toString(), _magic(spark, path, 2) == b"\x1f\x8b"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        for batch in batches:
            if not batch.num_rows:
                continue
            system, place = arrow_fs.FileSystem.from_uri(uri)
            chunks, held, at, first, n = _stream(system, place, size, zipped), bytearray(), 0, 0, 0
            _take(held, chunks, 9)
            skip = 9 + struct.unpack_from("<I", held, 5)[0]
            _take(held, chunks, skip)
            del held[:skip]
            while _take(held, chunks, at + 8):
                length = 8 + sum(struct.unpack_from("<II", held, at))
                if not _take(held, chunks, at + length):
                    raise ValueError(f"record {first + n} is cut off")
                at, n = at + length, n + 1
                if at >= CHUNK:
                    yield pa.RecordBatch.from_pydict({"first": [first], "data": [bytes(held[:at])]})
                    del held[:at]
                    at, first, n = 0, first + n, 0
            if len(held) != at:
                raise ValueError(f"record {first + n} is cut off")
            if n:
                yield pa.RecordBatch.from_pydict({"first": [first], "data": [bytes(held)]})

    schema = spark.createDataFrame([], header.schema()).schema
    kind = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(header, text)
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist(list(decoder.chunk(first, data.as_py())), schema=kind)

    pieces = spark.range(0, 1, 1, 1).mapInArrow(cut, "first long, data binary")
    return pieces.repartition(tasks or spark.sparkContext.defaultParallelism, "first").mapInArrow(decode, schema), header


# ---------------------------------------------------------------- encoding

def _kind(code: int, n: int) -> bytes:
    return bytes([n << 4 | code]) if n < 15 else bytes([0xF0 | code]) + _integers([n])


def _width(values: list) -> int:
    """The narrowest type that holds values and its eight reserved ones."""
    known = [v for v in values if v is not None]
    low, high = min(known, default=0), max(known, default=0)
    return 1 if -120 <= low and high <= 127 else 2 if -32760 <= low and high <= 32767 else 3


def _integers(values: list) -> bytes:
    if not values:
        return b"\x00"
    code = _width(values)
    dtype, missing, _ = INTS[code]
    return _kind(code, len(values)) + np.array([missing if v is None else v for v in values], dtype).tobytes()


def _floats(values: list) -> bytes:
    bits = np.array([0.0 if v is None else v for v in values], "<f4").view("<u4").copy()
    bits[[i for i, v in enumerate(values) if v is None]] = FLOAT_MISSING
    return bits.tobytes()


def _text(value: str) -> bytes:
    raw = value.encode("utf-8")
    return _kind(CHAR, len(raw)) + raw


def _joined(value, f: Field) -> str:
    """The text of a text field's value."""
    return (value if value is not None else ".") if f.scalar else ",".join("." if v is None else v for v in value or [None])


class Encoder:
    """Records' bytes from rows of the data model."""

    def __init__(self, header: VariantHeader):
        self.header = header
        strings, contigs = dictionary("\n".join(header.lines()))
        self.string, self.contig = {s: i for i, s in enumerate(strings)}, {c: i for i, c in enumerate(contigs)}

    def head(self) -> bytes:
        text = "".join(f"{line}\n" for line in self.header.lines()).encode("utf-8") + b"\0"
        return MAGIC + struct.pack("<I", len(text)) + text

    def number(self, table: dict[str, int], name: str, row: dict) -> int:
        if name not in table:
            raise ValueError(f"{name} at {row['chrom']}:{row['pos']} is not in the header")
        return table[name]

    def record(self, row: dict) -> bytes:
        h, out = self.header, bytearray()
        info, samples = row.get("info") or {}, row.get("samples") or []
        out += _text(";".join(row["ids"]) or ".")
        for allele in [row["ref"], *row["alts"]]:
            out += _text(allele)
        out += _integers([self.number(self.string, f, row) for f in row["filters"]])
        n_info = 0
        for k, f in h.infos.items():
            value = info.get(k)
            if value is None or value is False:
                continue
            n_info += 1
            out += _integers([self.string[k]])
            listed = [value] if f.scalar else value
            if f.type == "Flag":
                out += b"\x00"
            elif f.type == "Integer":
                out += _integers(listed)
            elif f.type == "Float":
                out += _kind(FLOAT, len(listed)) + _floats(listed)
            else:
                out += _text(_joined(value, f))
        own, n_formats = bytearray(), 0
        for k, f in h.formats.items() if samples else ():
            column = [s.get(k) for s in samples]
            if k != "GT" and all(v is None for v in column):
                continue
            n_formats += 1
            own += _integers([self.string[k]]) + (self._calls(column) if k == "GT" else self._column(column, f))
        end = info.get("END")
        length = end - row["pos"] + 1 if isinstance(end, int) and end >= row["pos"] else len(row["ref"])
        qual = FLOAT_MISSING if row["qual"] is None else struct.unpack("<I", struct.pack("<f", row["qual"]))[0]
        fixed = struct.pack("<iiiIII", self.number(self.contig, row["chrom"], row), row["pos"] - 1, length, qual, (1 + len(row["alts"])) << 16 | n_info, n_formats << 24 | len(samples))
        return struct.pack("<II", len(fixed) + len(out), len(own)) + fixed + bytes(out) + bytes(own)

    @staticmethod
    def _calls(column: list) -> bytes:
        coded = [[0] if c is None or not c["alleles"] else [((a + 1) << 1 if a is not None else 0) | (i > 0 and bool(p)) for i, (a, p) in enumerate(zip(c["alleles"], c["phased"], strict=True))] for c in column]
        return _matrix(coded)

    @staticmethod
    def _column(column: list, f: Field) -> bytes:
        if f.type not in ("Integer", "Float"):
            raw = [_joined(v, f).encode("utf-8") for v in column]
            n = max(map(len, raw))
            return _kind(CHAR, n) + b"".join(r.ljust(n, b"\0") for r in raw)
        listed = [[v] if f.scalar else (v or [None]) for v in column]
        if f.type == "Integer":
            return _matrix(listed)
        n = max(map(len, listed))
        return _kind(FLOAT, n) + b"".join(_floats(v) + struct.pack("<I", FLOAT_END) * (n - len(v)) for v in listed)


def _matrix(rows: list[list]) -> bytes:
    """Integers of every sample, filled up to the longest."""
    n, code = max(map(len, rows)), _width([v for r in rows for v in r])
    dtype, missing, end = INTS[code]
    return _kind(code, n) + np.array([[missing if v is None else v for v in r] + [end] * (n - len(r)) for r in rows], dtype).tobytes()


def write_bcf(df: DataFrame, header: VariantHeader, path: str, compress: bool = True, overwrite: bool = False, ordered: bool = False) -> None:
    """A folder of sorted parts whose concatenation in the order of their names is one BCF (BGZF, or raw), in one commit.
    ordered: df is sorted."""
    refuse_own_input(df, path)
    spark = df.sparkSession
    schema = spark.createDataFrame([], header.schema()).schema
    rows = df.select(*schema.fieldNames())
    rows = rows if ordered else rows.repartitionByRange("contig_idx", "pos", "row_id").sortWithinPartitions("contig_idx", "pos", "row_id")
    # the header is the first partition: a row of nulls
    top = spark.range(0, 1, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        encoder = Encoder(header)
        for batch in batches:
            made = bytearray()
            for row in batch.to_pylist():
                made += encoder.head() if row["row_id"] is None else encoder.record(row)
            yield bytes(made)

    commit_blocks(top.unionByName(rows), chunks, path, "bcf", compress=compress, overwrite=overwrite)
