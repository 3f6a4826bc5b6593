"""Words of whole Arrow text columns as NumPy arrays, and hashes of word runs.

A word is a maximal run of characters other than the ASCII white space
`\\x20 \\x09-\\x0D`. Nothing here loops over words in Python: a column's texts lie
behind one another in one buffer, and every step works on the whole buffer.
"""

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _SEED.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_FOLDED = _BYTES[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Odd, and 3 modulo 8, so that swapped letters lose one bit only.
_BASE = np.uint64(0x9E3779B97F4A7C1B)
_TURN = np.uint64(0xD6E8FEB86659FD93)
_JOIN = np.uint64(0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(32)
    h *= _TURN
    h ^= h >> np.uint64(29)
    h *= _TURN
    h ^= h >> np.uint64(32)
    return h


def text_buffer(column: pa.Array):
    """The UTF-8 bytes of a text column and the n + 1 offsets; null as empty."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a text column: byte bounds, hashes, and the words of each text.

    `first[i]:first[i + 1]` are the words of text i in `start`, `end`, `hash`.
    """

    def __init__(self, column: pa.Array, fold_case=False):
        data, offsets = text_buffer(column)
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~_SPACE[data]
        begins = inside.copy()
        begins[1:n] &= ~inside[: max(n - 1, 0)]
        cut = offsets[(offsets > 0) & (offsets < n)]
        begins[cut] = inside[cut]
        ends = np.zeros(n + 1, bool)
        ends[1:] = inside[:n] & ~inside[1:]
        ends[cut] = inside[cut - 1] if len(cut) else False
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        table = _FOLDED if fold_case else _BYTES
        self.hash = _word_hashes(data, self.start, self.end, table)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, size: int) -> np.ndarray:
        """Hashes of `size` words from each word on.

        The last `size - 1` places, and those near a text's end, hold runs over
        that end; `whole_runs` tells which lie inside one text.
        """
        return join_runs(self.hash, size)

    def whole_runs(self, size: int) -> np.ndarray:
        """For each text, the number of places where a run of `size` words fits."""
        return np.maximum(self.counts() - size + 1, 0)


def _word_hashes(data, start, end, table, chunk=1 << 20):
    """Polynomial hashes of the words, in chunks that stay in the cache."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    longest = int((end - start).max())
    with np.errstate(over="ignore"):
        at, size = 0, min(len(data), chunk + longest)
        powers = _powers(_BASE, size)
        inverses = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), size)
        while at < len(start):
            # As many words as fill a chunk of bytes, one at least.
            stop = max(at + 1, int(np.searchsorted(end, start[at] + chunk, "right")))
            low, high = start[at], end[stop - 1]
            sums = np.zeros(int(high - low) + 1, np.uint64)
            np.cumsum(table[data[low:high]] * powers[: high - low], out=sums[1:])
            a, b = start[at:stop] - low, end[at:stop] - low
            h = (sums[b] - sums[a]) * inverses[a]
            out[at:stop] = mix(h + (b - a).astype(np.uint64) * _JOIN)
            at = stop
    return out


def _powers(base, n):
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def join_runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` hashes in a row, from those of powers of two."""
    n = len(h)
    with np.errstate(over="ignore"):
        run, step, done, out = h, 1, 0, None
        while True:
            if size & step:
                if out is None:
                    out = run.copy()
                else:
                    # `out` covers the `done` words before this part.
                    joined = out * _JOIN
                    joined[: max(n - done, 0)] += run[done:]
                    out = mix(joined + np.uint64(step))
                done += step
            step *= 2
            if step > size:
                return out
            double = run * _JOIN
            double[: max(n - step // 2, 0)] += run[step // 2 :]
            run = mix(double + np.uint64(step))


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """The least of `size` values from each place on (fewer at the end)."""
    out, have = h.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
