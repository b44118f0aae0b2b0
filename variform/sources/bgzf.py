"""Blocked gzip: reading byte ranges of a file on many tasks, and writing blocks. The blocks are gzip members with their own
size in an extra field, so a task finds the next one from anywhere."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: Fixed value: the empty block that ends a file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a block before compression, which keeps the compressed block under 64 KiB.
PAYLOAD = 0xFF00
_HEADER = b"\x1f\x8b\x08\x04"


def block(payload: bytes, level: int = 6) -> bytes:
    """One block of at most PAYLOAD bytes."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(payload) + deflate.flush()
    if len(body) + 26 > 0x10000:  # what does not compress is stored
        deflate = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = deflate.compress(payload) + deflate.flush()
    head = _HEADER + struct.pack("<IBBHBBHH", 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def blocks(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks of a stream of bytes, without the last empty one."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while len(held) >= PAYLOAD:
            yield block(bytes(held[:PAYLOAD]))
            del held[:PAYLOAD]
    if held:
        yield block(bytes(held))


def block_size(data: bytes, at: int) -> int | None:
    """Size of the block that starts at a place, None if none does there."""
    if data[at : at + 4] != _HEADER or len(data) < at + 18:
        return None
    extra, = struct.unpack_from("<H", data, at + 10)
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(data)):
        size, = struct.unpack_from("<H", data, i + 2)
        if data[i : i + 2] == b"BC" and size == 2 and i + 6 <= len(data):
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + size
    return None


def first_block(data: bytes) -> int:
    """The first place in data where blocks follow one another, -1 if there is none."""
    at = data.find(_HEADER)
    while at >= 0:
        size, place = block_size(data, at), at
        # three in a row, or as many as data holds
        for _ in range(3):
            if size is None:
                break
            place += size
            if place + 18 > len(data):
                return at
            size = block_size(data, place)
        else:
            return at
        if size is not None:
            return at
        at = data.find(_HEADER, at + 1)
    return -1


def payloads(stream, start: int, end: int, whole: int) -> Iterator[tuple[bool, bytes]]:
    """(whether it starts at or behind end, payload) of the blocks from start on; stream: a seekable file of ``whole`` bytes."""
    stream.seek(start)
    data = stream.read(min(whole, start + (1 << 18)) - start)
    at = 0 if not start else first_block(data)
    if at < 0:
        return
    place = start + at
    while place < whole:
        while (size := block_size(data, at)) is None or len(data) - at < size:
            got = stream.read(1 << 20)
            if not got:
                raise ValueError(f"the block at {place} is cut off or is no block")
            data, at = data[at:] + got, 0
        head, tail = at + 12 + struct.unpack_from("<H", data, at + 10)[0], at + size - 8
        payload = zlib.decompress(data[head:tail], -15)
        if zlib.crc32(payload) != struct.unpack_from("<I", data, tail)[0]:
            raise ValueError(f"the block at {place} is damaged")
        yield place >= end, payload
        at, place = at + size, place + size


def _own_text(stream, start: int, end: int, whole: int) -> Iterator[bytes]:
    """The text of the lines whose preceding line feed (or the file's start) is in the blocks that start in [start, end)."""
    skip = start > 0
    for past, payload in payloads(stream, start, end, whole):
        if skip:
            # the first line is the range's before
            cut = payload.find(b"\n")
            if past:
                return
            if cut < 0:
                continue
            payload, skip = payload[cut + 1 :], False
        elif past and (cut := payload.find(b"\n")) >= 0:
            yield payload[: cut + 1]
            return
        yield payload


def whole_lines(chunks: Iterator[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """The chunks of a text, joined to about ``size`` bytes and cut behind a line feed; the last line may lack it."""
    held, n = [], 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk)
        if n >= size:
            text = b"".join(held)
            cut, n = text.rfind(b"\n") + 1, 0
            if cut:
                yield text[:cut]
            held = [text[cut:]]
    if text := b"".join(held):
        yield text


def pieces(stream, start: int, end: int, whole: int) -> Iterator[bytes]:
    """The lines of a range, see ``_own_text``, many in a piece."""
    return whole_lines(_own_text(stream, start, end, whole))


def lines(stream, start: int, end: int, whole: int) -> Iterator[bytes]:
    """The lines of a range, see ``_own_text``, without their line feeds."""
    for piece in pieces(stream, start, end, whole):
        yield from piece.removesuffix(b"\n").split(b"\n")
