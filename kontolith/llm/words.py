"""64-bit word hashes of whole Arrow string columns, in numpy over the column's bytes.

Words are runs without ASCII white space. A word's hash is a polynomial over random values of its bytes, taken as a
difference of running sums, so the work per byte is a few vector operations. Long texts are cut into blocks between
words; memory is bounded by the block (or one longer word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kontolith.llm.common import mix64

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20_240_501).integers(0, 1 << 64, 256, np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _LOWER[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & ((1 << 64) - 1)))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    def __init__(self, lower: bool = False):
        self.table = _LOWER if lower else _TABLE
        self.up, self.down = _powers(_BASE, BLOCK), _powers(pow(_BASE, -1, 1 << 64), BLOCK)

    def _block(self, d: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and hashes of the words of ``d``; rows begin at the positions ``inner``."""
        if len(d) > len(self.up):
            self.up, self.down = _powers(_BASE, len(d)), _powers(pow(_BASE, -1, 1 << 64), len(d))
        sp = SPACE[d]
        before, after = np.empty(len(d), bool), np.empty(len(d), bool)
        before[0], before[1:], after[-1], after[:-1] = True, sp[:-1], True, sp[1:]
        before[inner], after[inner[inner > 0] - 1] = True, True
        begin, end = np.flatnonzero(~sp & before), np.flatnonzero(~sp & after) + 1
        run = np.empty(len(d) + 1, np.uint64)
        run[0] = 0
        np.cumsum(self.table[d] * self.up[: len(d)], out=run[1:])
        return begin, mix64((run[end] - run[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * _LENGTH)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the column, row after row, and each row's number of words; null rows have none."""
        column = column.cast(pa.large_binary())
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        pos, stop = int(off[0]), int(off[-1])
        hashes, counts = [], np.zeros(n, np.int64)
        while pos < stop:
            to = min(pos + BLOCK, stop)
            if to < stop:
                row_end = int(off[np.searchsorted(off, to, "right") - 1])
                if row_end > pos:
                    to = row_end
                else:  # one long text: end the block at white space
                    gaps = np.flatnonzero(SPACE[data[pos:to]])
                    if len(gaps):
                        to = pos + int(gaps[-1]) + 1
                    else:
                        row_end = int(off[np.searchsorted(off, to, "right")])
                        gaps = np.flatnonzero(SPACE[data[to:row_end]])
                        to = to + int(gaps[0]) if len(gaps) else row_end
            first, last = np.searchsorted(off, pos, "right"), np.searchsorted(off, to, "left")
            inner = off[first:last] - pos
            begin, h = self._block(data[pos:to], inner[inner < to - pos])
            hashes.append(h)
            edges = np.searchsorted(begin, np.concatenate(([0], off[first:last] - pos, [to - pos])))
            np.add.at(counts, np.arange(first - 1, last), np.diff(edges))
            pos = to
        return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts
