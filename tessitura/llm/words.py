"""Words of whole texts as hashes, vectorised over Arrow columns in blocks of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that end a word: blank, tab, line feed, vertical tab, form feed, carriage return.
GAP = b" \t\n\x0b\x0c\r"
#: Bytes of text handled at once; a longer text is handled in pieces that end between words.
BLOCK_BYTES = 1 << 19
#: Bytes of a word that are hashed in steps of eight; longer words are hashed by BLAKE2.
STEPPED = 64

_IS_GAP = np.zeros(256, bool)
_IS_GAP[list(GAP)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_KEY = b"tessitura words"


def text_column(col: Column) -> Column:
    """Null as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes and offsets (from 0) of runs of texts, or of bytes, of about BLOCK_BYTES. No nulls."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes_of(low: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of lower-cased bytes: eight bytes after the other are mixed into what the ones before gave."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    h = _mixed(width.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    some = np.flatnonzero(width <= STEPPED)
    step = 0
    while len(some):
        piece = eight[start[some] + step] & _MASKS[np.minimum(width[some] - step, 8)]
        h[some] = _mixed(h[some] ^ (piece * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(step + 1)))
        step += 8
        some = some[width[some] > step]
    for k in np.flatnonzero(width > STEPPED):
        word = low[start[k] : start[k] + width[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
    return h


def _words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and first place and width of each word."""
    word = np.concatenate([[False], ~_IS_GAP[raw], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return _LOWER[raw], edges[::2], edges[1::2] - edges[::2]


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of about BLOCK_BYTES that end between words (a word longer than that is in one piece)."""
    at = 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        while end < len(raw):
            gap = np.flatnonzero(_IS_GAP[raw[end : end + BLOCK_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end += BLOCK_BYTES
        yield raw[at:end]
        at = end


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block: number of the first text, 64-bit hashes of the lower-cased words, words of each text."""
    for first, raw, off in blocks(column):
        n = len(off) - 1
        if n == 1 and len(raw) > BLOCK_BYTES:
            found = np.concatenate([hashes_of(*_words_of(piece)) for piece in _pieces(raw)])
            yield first, found, np.array([len(found)], np.int64)
            continue
        low, start, width = _words_of(raw)
        if n > 1 and len(start):  # words that touch a text's end are cut there
            cut = off[1:-1]
            at = np.searchsorted(start, cut, side="right") - 1
            inside = (at >= 0) & (start[at] < cut) & (cut < start[at] + width[at])
            if inside.any():
                ends = start + width
                start = np.unique(np.concatenate([start, cut[inside]]))
                ends = np.unique(np.concatenate([ends, cut[inside]]))
                width = ends - start
        counts = np.searchsorted(start, off[1:], side="left") - np.searchsorted(start, off[:-1], side="left")
        yield first, hashes_of(low, start, width), counts.astype(np.int64)


def sequence_digest(column: pa.Array) -> list[bytes | None]:
    """For each text a 128-bit digest of its lower-cased word sequence, None without words."""
    out: list[bytes | None] = []
    for text in column:
        raw = np.frombuffer(text.as_buffer(), np.uint8)
        digest, words = hashlib.blake2b(digest_size=16), 0
        for piece in _pieces(raw):
            split = piece.tobytes().lower().split()
            if split:
                digest.update((b" " if words else b"") + b" ".join(split))
                words += len(split)
        out.append(digest.digest() if words else None)
    return out
