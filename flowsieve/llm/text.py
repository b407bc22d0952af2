"""Shared helpers of the text operators: bounded slices of Arrow batches, words, substring hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a slice holds at most, unless a single row has more.
SLICE_BYTES = 4 << 20
#: Upper-case A-Z to lower case, every other ASCII character that is no letter or digit to a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of a text column; whole rows only, none left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of the texts; NULL is empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts; NULL is empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def space_words(raw: bytes) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), A-Z lowered."""
    return raw.lower().split()


def plain_words(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lowered."""
    return raw.translate(WORD_TABLE).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cached: dict[str, np.ndarray] = {"up": _powers(_BASE, 1024), "down": _powers(_INVERSE, 1024)}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[bytes], width: int, piece: int = 200_000) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words (the whole sequence, if it is shorter), repeats included.

    A prefix sum over the bytes gives the hash of any substring, so no run is built as a string. Equal runs have
    equal hashes; callers compare the words themselves where a chance collision would matter.
    """
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    out = []
    for at in range(0, len(words) - width + 1, piece):
        line = np.frombuffer(b" ".join(words[at : at + piece + width - 1]), np.uint8)
        if len(line) >= len(_cached["up"]):
            _cached.update(up=_powers(_BASE, 2 * len(line)), down=_powers(_INVERSE, 2 * len(line)))
        sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum((line.astype(np.uint64) + np.uint64(1)) * _cached["up"][: len(line)], out=sums[1:])
        gaps = np.flatnonzero(line == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))
        first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
        out.append(mixed((sums[last] - sums[first]) * _cached["down"][first]))
    return np.concatenate(out)
