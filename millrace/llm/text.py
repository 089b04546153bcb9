"""Whole texts as byte arrays: words, shingles and fingerprints for a batch at once.

Every function works on one buffer of concatenated UTF-8 texts and the offsets
of the texts in it, so that numpy does the work and nothing is done per word.
A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The separators of words are space and the controls 9 to 13.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII capitals to small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20

#: Bytes of text whose hashes are summed up at once.
STRETCH = 1 << 17

#: Stands for a null doc_id where arrays can hold none.
NO_ID = -(2**63)

_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(name: str) -> np.ndarray:
    """The first ``STRETCH`` powers of the base, or of its inverse; others are products of two."""
    if len(_POWERS[name]) == 1:
        steps = np.full(STRETCH, {"up": _BASE, "down": _INVERSE}[name], dtype=np.uint64)
        steps[0] = 1
        _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each is there."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def is_among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each key is one of the sorted distinct ones."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def own_ids(ids: np.ndarray) -> pa.Array:
    """The doc_ids of a batch as an Arrow column, with the nulls they came with."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


class Texts:
    """Texts of a batch: ``data`` holds their bytes, text i is ``data[ends[i]:ends[i+1]]``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, ids: np.ndarray | None = None):
        self.data, self.ends, self.ids = data, ends, ids

    def __len__(self) -> int:
        return len(self.ends) - 1

    @classmethod
    def of(cls, column: pa.Array, ids: pa.Array | None = None) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        # nulls are filled here: numpy would turn the whole column into doubles
        numbers = None if ids is None else ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        return cls(data, ends - ends[0], numbers)

    def text(self, i: int) -> bytes:
        return self.data[self.ends[i] : self.ends[i + 1]].tobytes()

    def prefix_hashes(self, lower: bool = False) -> np.ndarray:
        """Running polynomial sums; the difference of two, scaled, is a substring's fingerprint."""
        up = _powers("up")
        table = _RANDOM[LOWER] if lower else _RANDOM
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        # stretch by stretch: more arrays of eight times the text would be most of what a worker holds
        for k in range(0, len(self.data), STRETCH):
            part = table[self.data[k : k + STRETCH]]
            part *= up[: len(part)]
            part *= np.uint64(pow(int(_BASE), k, 2**64))
            part[:1] += out[k]
            np.cumsum(part, out=out[k + 1 : k + 1 + len(part)], dtype=np.uint64)
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each text (and the total)."""
        inside = ~SEPARATOR[self.data]
        full = self.ends[:-1] < self.ends[1:]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        before[self.ends[:-1][full]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[self.ends[1:][full] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.ends)


def fingerprints(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the substrings; equal strings have equal ones."""
    far = np.array([pow(int(_INVERSE), k, 2**64) for k in range(0, len(prefix), STRETCH)], np.uint64)
    sums = prefix[ends] - prefix[starts]
    sums *= _powers("down")[starts % STRETCH]
    sums *= far[starts // STRETCH]
    return mix(sums + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``n`` words that stay in a text, and each text's first run."""
    counts = np.maximum(np.diff(firsts) - n + 1, 0)
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(firsts), np.int64)
    joined = words[:total].copy()
    for k in range(1, n):
        joined *= np.uint64(0x9E3779B97F4A7C15)
        joined += words[k : k + total]
        joined ^= joined >> np.uint64(29)
    first = np.concatenate([[0], np.cumsum(counts)])
    take = np.arange(first[-1]) + np.repeat(firsts[:-1] - first[:-1], counts)
    return mix(joined[take]), first


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``limit`` bytes, or are one text."""
    size = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
