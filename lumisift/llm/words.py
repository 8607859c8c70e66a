"""Vectorised word hashing for Arrow batches: the small numpy helper that several operators share.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Every word becomes a 64-bit hash: a sum of
random per-byte values times powers of an odd base (so that one running sum serves all words of a
chunk), then a final mix. Runs of words are hashed the same way one level up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; longer texts are cut at white space, so memory stays bounded.
CHUNK = 1 << 20
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_WORD_BASE, _RUN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    had = _powers.get(base)
    if had is None or len(had[0]) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            one = np.full(size, base, np.uint64)
            inv = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            one[0] = inv[0] = 1
            had = (np.multiply.accumulate(one), np.multiply.accumulate(inv))
        if size <= 4 * CHUNK:
            _powers[base] = had
    return had


def _chunk_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one buffer."""
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = powers(_WORD_BASE, len(buf))
    with np.errstate(over="ignore"):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)))
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes, cut where white space stands."""
    at = 0
    while at < len(text):
        stop = at + CHUNK
        while stop < len(text) and not _SPACE[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in order, and the number of words of each text."""
    out: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first = size = 0

    def flush(stop: int) -> None:
        nonlocal group, size
        if not group:
            return
        hashes, start = _chunk_hashes(b" ".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        counts[first:stop] = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
        out.append(hashes)
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            flush(i)
            for part in _pieces(text):
                hashes, _ = _chunk_hashes(part)
                counts[i] += len(hashes)
                out.append(hashes)
            first = i + 1
            continue
        if size + len(text) > CHUNK:
            flush(i)
            first = i
        group.append(text)
        size += len(text) + 1
    flush(len(texts))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def run_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums from which span() takes the hash of any run of words."""
    up, _ = powers(_RUN_BASE, len(hashes))
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end-1, the same wherever the run stands."""
    _, down = powers(_RUN_BASE, len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def doc_starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about limit bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def even_batches(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches of any columns in parts of as many rows each as make about limit bytes, or one row."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, batch.num_rows // max(1, -(-batch.nbytes // limit)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def vote_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each group's 64-bit hashes set each bit: an array of len(counts) x 64, bit 0 first.

    Eight one-byte lanes ride in one 64-bit word, so segments hold at most 255 hashes.
    """
    out = np.zeros((len(counts), 64), np.int64)
    starts = doc_starts(counts)
    segments, owner = [], []
    for i in np.flatnonzero(counts):
        cut = range(int(starts[i]), int(starts[i + 1]), 255)
        segments.extend(cut)
        owner.extend([i] * len(cut))
    if not segments:
        return out
    segments, owner = np.array(segments), np.array(owner)
    lane = U(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((hashes >> U(j)) & lane, segments)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)  # little endian: lane k counts bit 8k + j
        np.add.at(out[:, j::8], owner, lanes)
    return out
