"""Documents of an Arrow batch as byte blocks: word and line spans, and 64-bit hashes of spans, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that a block's arrays fit the CPU's cache. A document is never cut, so a longer one
#: makes a block of its own.
BLOCK_BYTES = 1 << 19

_U = np.uint64
#: Odd, so that they have an inverse modulo 2^64.
_BASES = {False: 0x9E3779B97F4A7C15, True: 0xC2B2AE3D27D4EB4F}


def _blanks() -> np.ndarray:
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return blank


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Block:
    """Whole documents back to back. ``offsets`` has one entry more than there are documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._prefix: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that are no ``gap``, cut at document borders."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, after = np.ones_like(gap), np.ones_like(gap)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(gap))]
        before[edges], after[edges - 1] = True, True
        return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of ``[^\\x20\\x09-\\x0D]+``."""
        return self.spans(_blanks()[self.data])

    def doc_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def per_doc(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions lie in each document."""
        return np.diff(np.searchsorted(positions, self.offsets))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
        """64-bit polynomial hash of each span, mixed with its length; equal bytes hash alike in any block.

        ``other`` takes an independent base and byte values.
        """
        if other not in self._prefix:
            base, n = _BASES[other], len(self.data)
            sums = np.zeros(n + 1, dtype=_U)
            values = _values(other)[self.data]
            values *= _powers(base, n)
            np.cumsum(values, out=sums[1:])
            self._prefix[other] = sums, _powers(pow(base, -1, 1 << 64), n + 1)
        sums, back = self._prefix[other]
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those for blocks of the usual size are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES + 1), base, dtype=_U)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 2 * BLOCK_BYTES:
            _POWERS[base] = known
    return known[:n]


def grams(block: Block, k: int) -> np.ndarray:
    """64-bit hash of the ``k`` bytes from every position on."""
    n = len(block.data)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_values(False)[block.data] * _powers(_BASES[False], n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(pow(_BASES[False], -1, 1 << 64), n - k + 1))


def _values(other: bool) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) + _U(1000 * other))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, block) over a text column, in blocks of about ``limit`` bytes."""
    data, offsets = column_bytes(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, Block(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        first = end


def lowered(block: Block) -> Block:
    """A-Z in lower case, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return Block(table[block.data], block.offsets)


def sums_by_doc(block: Block, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the spans of each document; spans are in order."""
    total = np.concatenate([[0], np.cumsum(values)])
    cuts = np.searchsorted(starts, block.offsets)
    return total[cuts[1:]] - total[cuts[:-1]]


def repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, key): whether it occurs twice or more, and whether an equal one stands before it."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    often, later = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=bool)
    often[order] = same[:-1] | same[1:]
    later[order] = same[:-1]  # lexsort is stable: the first of equals stays in front
    return often, later
