"""Words, hashes and small shared steps of the corpus operators.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return; ``bytes.split()`` on UTF-8 cuts exactly there.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

# Hash parameters: any odd multipliers and any byte table do; they only have to stay the same.
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, np.ndarray] = {0: np.ones(1, np.uint64), 1: np.ones(1, np.uint64)}


def powers(which: int, n: int) -> np.ndarray:
    """First ``n`` powers of a hash multiplier, modulo 2^64."""
    if len(_powers[which]) < n:
        grown = np.full(max(n, 2 * len(_powers[which]), 64), _MULTIPLIERS[which], np.uint64)
        grown[0] = 1
        _powers[which] = np.cumprod(grown)
    return _powers[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: Sequence[bytes], hashes: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Independent 64-bit hashes of every word of the texts, in order, and words per text."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    space = _SPACE[buffer]
    solid = ~space
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    per_text = np.diff(np.searchsorted(starts, np.append(offsets, len(buffer) + 1)))
    lengths = ends - starts
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in range(hashes)], per_text
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    letters = buffer[solid]
    longest = int(lengths.max())
    return [
        mix(np.add.reduceat(_TABLES[k][letters] * powers(k, longest)[place], first) + lengths.astype(np.uint64))
        for k in range(hashes)
    ], per_text


def window_hashes(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes (also those that span two texts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = powers(which, size)
    out = words[:n] * weights[0]
    for i in range(1, size):
        out += words[i : i + n] * weights[i]
    return mix(out)


def parts_by_bytes(sizes: Iterable[int], limit: int) -> list[tuple[int, int]]:
    """Cut a row range into consecutive pieces of about ``limit`` bytes (one row at least)."""
    cuts, begin, total, i = [], 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            cuts.append((begin, i))
            begin, total = i, 0
        total += n
    if i >= begin:
        cuts.append((begin, i + 1))
    return cuts


def sizes_of(column: pa.Array) -> list[int]:
    """Bytes of each text; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def crc_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def n_words(text: Column) -> Column:
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column by exact name, cast; null where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


_holders: dict[str, Callable[[], None]] = {}


def hold_memory(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Let an operator keep words in this worker; what others keep here is forgotten.

    Workers serve one stage after the other; without this, each would add its memory to theirs.
    """
    others = [o for o in _holders if o != owner]
    for other in others:
        _holders.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    _holders[owner] = forget


def per_batch(run: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """Function for ``mapInArrow`` out of one on single batches."""

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                out = run(batch)
                if out is not None and out.num_rows:
                    yield out

    return each
