"""What token counts and segmentations share: a table of pieces, growing arrays, batches."""

from __future__ import annotations

import numpy as np

SPACE = "▁"
#: Code points of the texts that are worked on together, beyond the first text.
BATCH_CHARS = 250_000
BASE, _SLOT1, _SLOT2 = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def n_bytes(codes: np.ndarray) -> np.ndarray:
    """Bytes of code points in UTF-8."""
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


class Vocabulary:
    """Pieces and a table that finds the piece of a substring's hash."""

    def __init__(self, pieces: list[str], ids: list[int]) -> None:
        self.pieces, self.ids = pieces, np.array(ids, np.int32)
        self.longest = max(map(len, pieces))
        keys: dict[int, int] = {}
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                keys.setdefault(h, -1)  # a beginning of a piece
            keys[h] = i
        hashes, places = np.array(list(keys), np.uint64), np.array(list(keys.values()), np.int32)
        self.bits = (max(10, (16 * len(hashes)).bit_length()), 17)
        self.keys = [np.zeros(1 << n, np.uint64) for n in self.bits]
        self.values = [np.full(1 << n, -2, np.int32) for n in self.bits]
        self.multiplier = [_SLOT1, _SLOT2]
        at = self.slots(hashes, 0)
        _, first = np.unique(at, return_index=True)
        self.keys[0][at[first]], self.values[0][at[first]] = hashes[first], places[first]
        rest = np.delete(np.arange(len(hashes)), first)  # those whose slot was taken go to the second, small table
        for i in range(1000):
            self.multiplier[1] = np.uint64(int(_SLOT2) + 2 * i)
            at = self.slots(hashes[rest], 1)
            if len(np.unique(at)) == len(at):
                break
        else:
            raise ValueError("the tables of pieces are too small")
        self.keys[1][at], self.values[1][at] = hashes[rest], places[rest]

    def slots(self, h: np.ndarray, t: int) -> np.ndarray:
        return ((h * self.multiplier[t]) >> np.uint64(64 - self.bits[t])).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """What has these hashes: the place of a piece, -1 for a beginning of pieces only, -2 for neither."""
        at = self.slots(h, 0)
        found = np.where(self.keys[0][at] == h, self.values[0][at], np.int32(-2))
        miss = np.flatnonzero(found == -2)
        at = self.slots(h[miss], 1)
        hit = np.flatnonzero(self.keys[1][at] == h[miss])
        found[miss[hit]] = self.values[1][at[hit]]
        return found

    def pieces_in(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, first rows, code points and pieces of chunks: a row per character and one per end, a
        column per length, in it the place of the piece that begins there, or -1."""
        lengths = np.array([len(c) for c in chunks], np.int64)
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        codes = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        rem = np.repeat(base[1:] - 1, lengths + 1) - np.arange(len(codes))
        piece = np.full((len(codes), self.longest), -1, np.int32)
        rows = np.flatnonzero(rem > 0)
        h = np.zeros(len(rows), np.uint64)
        for length in range(1, self.longest + 1):
            if length > 1:
                far = rem[rows] >= length
                rows, h = rows[far], h[far]
            h = h * BASE + codes[rows + length - 1]
            found = self.find(h)
            hit = np.flatnonzero(found >= 0)
            piece[rows[hit], length - 1] = found[hit]
            more = found != -2
            rows, h = rows[more], h[more]
        return lengths, base, (codes - np.uint64(1)).astype(np.int64), piece

    def cells_in(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Lengths, first rows and code points of chunks, as ``pieces_in`` has them, and for the pieces in
        them, row by row and the shorter ones first: row, length, place. A character that is no piece
        alone is a cell of its own, at place -1."""
        lengths = np.array([len(c) for c in chunks], np.int64)
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        codes = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        rem = np.repeat(base[1:] - 1, lengths + 1) - np.arange(len(codes))
        rows = np.flatnonzero(rem > 0)
        h = np.zeros(len(rows), np.uint64)
        count = np.zeros(len(codes), np.int64)
        hits = []
        for length in range(1, self.longest + 1):
            if length > 1:
                far = rem[rows] >= length
                rows, h = rows[far], h[far]
            h = h * BASE + codes[rows + length - 1]
            found = self.find(h)
            hit = np.flatnonzero(found >= 0) if length > 1 else np.arange(len(found))
            hits.append((rows[hit], np.maximum(found[hit], -1)))
            count[rows[hit]] += 1
            more = found != -2
            rows, h = rows[more], h[more]
        n = int(count.sum())
        at = np.cumsum(count) - count
        row, size, piece = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int32)
        for length, (some, found) in enumerate(hits, 1):
            to = at[some]
            row[to], size[to], piece[to] = some, length, found
            at[some] += 1
        return lengths, base, (codes - np.uint64(1)).astype(np.int64), row, size, piece


class Grown:
    """An array that grows at its end and can be cut back."""

    def __init__(self, kind: type) -> None:
        self.a, self.n = np.empty(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        need = self.n + len(x)
        if need > len(self.a):
            a = np.empty(max(need, len(self.a) * 3 // 2), self.a.dtype)
            a[: self.n] = self.a[: self.n]
            self.a = a
        self.a[self.n : need] = x
        self.n = need


def batches_of(texts: list[str], most: int = BATCH_CHARS):
    """Ranges of texts with about ``most`` code points each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
