"""Directly addressable codes: any token of a file by position, without decoding a block.

An id is split into 8-bit levels, lowest first. Level 0 has a byte of every id; a bitmap marks the ids that
go on, whose next bytes stand, in order, on level 1, and so on. A rank directory holds the number of marks
before every 512 bits, so the place of an id on the next level takes one look-up and one short count.

Segment, little-endian: ``HEAD`` (magic, size, shard, segment, ids of the shard before it, documents, ids,
levels), then doc_ids (int64), null flags (uint8), begin of each document (int64, one more than documents),
and for each level its number of bytes (int64), the bytes, bitmap and directory (uint32).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DACS"
HEAD = struct.Struct("<4sqqqqqqq")
_BLOCK = 64  # bytes of bitmap between entries of the directory


def encode_segment(shard: int, number: int, before: int, doc_ids: list, documents: list[np.ndarray]) -> bytes:
    """Bytes of one segment; a null doc_id is kept as such."""
    lens = np.fromiter(map(len, documents), np.int64, len(documents))
    ids = np.concatenate([*documents, np.zeros(0, np.uint32)]).astype(np.uint32)
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.concatenate([[0], np.cumsum(lens)]).astype("<i8").tobytes(),
    ]
    rest, levels = ids, 0
    while levels == 0 or len(rest):
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(bitmap).astype(np.int64)
        marks = np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), _BLOCK))) if len(ones) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], marks]).astype("<u4")
        parts += [struct.pack("<q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bitmap.tobytes(), directory.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    body = b"".join(parts)
    return HEAD.pack(MAGIC, HEAD.size + len(body), shard, number, before, len(documents), len(ids), levels) + body


class Segment:
    """One segment in a buffer, read in place."""

    def __init__(self, buffer, at: int = 0):
        magic, self.size, self.shard, self.number, self.before, docs, self.n_ids, levels = HEAD.unpack_from(buffer, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(buffer, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.begin = take("<i8", docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(take("<i8", 1)[0])
            bitmap = (n + 7) // 8
            self.levels.append((take("u1", n), take("u1", bitmap), take("<u4", (bitmap + _BLOCK - 1) // _BLOCK + 1)))

    def _rank(self, level: int, i: int) -> int:
        """Marks before bit ``i`` of a level."""
        _, bitmap, directory = self.levels[level]
        block = i // 8 // _BLOCK
        inside = bitmap[block * _BLOCK : i // 8]
        left = int(bitmap[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(directory[block]) + int(np.bitwise_count(inside).sum()) + left.bit_count()

    def __getitem__(self, i: int) -> int:
        """The id at position ``i`` of the segment."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * level
            if not bitmap[i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids at positions a to b (exclusive), as uint32: on each level they are one stretch."""
        out = np.zeros(b - a, np.uint32)
        where: np.ndarray | slice = slice(None)
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunk[a:b].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            a = self._rank(level, a) if more.any() else 0
            b = a + int(more.sum())
            where = np.flatnonzero(more) if level == 0 else where[more]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.begin[k]), int(self.begin[k + 1]))


def segments(content) -> list[Segment]:
    """The segments of a file, which stand one after another with one byte in between."""
    out, at = [], 0
    while at < len(content):
        out.append(Segment(content, at))
        at += out[-1].size + 1
    return out
