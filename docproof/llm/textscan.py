"""Words, shingles and their 64-bit hashes for many texts at once, in numpy.

A word is a run of bytes outside 0x09-0x0D and 0x20 of the UTF-8 text, A-Z lower-cased. Hashes of
different words or shingles are taken as different; with 64 bits that fails about once in 10**11
pairs of sets of ten thousand.
"""

import re

import numpy as np

WINDOW = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_rng = np.random.default_rng(11)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE, np.uint64))
    return _POWERS


def _windows(data: bytes):
    """Pieces of a long text, cut at white space, so that memory stays bounded by its words."""
    start = 0
    while len(data) - start > 2 * WINDOW:
        cut = _SPACE.search(data, start + WINDOW)
        if cut is None:
            break
        yield data[start : cut.end()]
        start = cut.end()
    yield data[start:]


def _hash_buffer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a buffer's words and where they start."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    letters = raw[np.repeat(starts, lengths) + within]
    powers = _powers(int(lengths.max()))
    sums = np.add.reduceat(_BYTES[letters] * powers[within], first)
    return mix(sums ^ lengths.astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets: text i has hashes[offsets[i]:offsets[i + 1]]."""
    hashes, counts, group, size = [], [], [], 0

    def flush():
        nonlocal group, size
        if group:
            found, starts = _hash_buffer(b"\n".join(group))
            bounds = np.cumsum([0, *[len(t) + 1 for t in group]])
            hashes.append(found)
            counts.extend(np.diff(np.searchsorted(starts, bounds)))
        group, size = [], 0

    for text in texts:
        text = text.lower()
        if len(text) > WINDOW:
            flush()
            parts = [_hash_buffer(piece)[0] for piece in _windows(text)]
            hashes.extend(parts)
            counts.append(sum(map(len, parts)))
            continue
        group.append(text)
        size += len(text)
        if size > WINDOW:
            flush()
    flush()
    joined = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return joined, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` words.

    A text with fewer words has its whole sequence as one shingle, a text without words none.
    """
    hashes, offsets = word_hashes(texts)
    odd = np.uint64(2 * words + 1)
    sets = []
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        own = hashes[begin:end]
        k = min(words, len(own))
        if k == 0:
            sets.append(own)
            continue
        total = np.full(len(own) - k + 1, k, np.uint64)
        for j in range(k):
            total = mix(total * odd + own[j : len(own) - k + 1 + j])
        total.sort()
        sets.append(total[np.concatenate(([True], total[1:] != total[:-1]))])
    return sets


def by_size(batch, column: int, most: int = 1 << 21):
    """Slices of an Arrow batch whose values in one text or binary column have about ``most`` bytes in all.

    So that a task never holds more than one slice as Python objects; a longer value is a slice alone.
    """
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty; no Python string is made."""
    import pyarrow as pa

    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def string_hashes(strings: list[bytes]) -> np.ndarray:
    """One hash per string, white space and letter case included."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    joined = np.frombuffer(b"".join(strings), np.uint8)
    hashes = np.zeros(len(strings), np.uint64)
    full = lengths > 0
    if full.any():
        sizes = lengths[full]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        within = np.arange(len(joined)) - np.repeat(first, sizes)
        hashes[full] = np.add.reduceat(_BYTES[joined] * _powers(int(sizes.max()))[within], first)
    return mix(hashes ^ lengths.astype(np.uint64))
