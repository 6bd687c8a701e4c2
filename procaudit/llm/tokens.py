"""Arrow batches of texts as flat arrays of word codes, for the operators that run NumPy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xBF58476D1CE4E5B9)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, words): text i has the words ``words[codes[offsets[i]:offsets[i + 1]]]``.

    Words are runs of anything but space and U+0009 to U+000D; ``lower`` turns A-Z to a-z. A null text has none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    owners = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(real).as_py():
        owners = owners[real.to_numpy(zero_copy_only=False)]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    offsets = np.searchsorted(owners, np.arange(len(parts) + 1))
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


#: Batches of texts are worked on in pieces of about so many bytes, so a worker's arrays stay small.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: int = -1) -> Iterator[pa.RecordBatch]:
    """The batches cut to pieces of about ``PIECE_BYTES`` of the text column; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text % batch.num_columns)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // PIECE_BYTES
        edges = np.concatenate([[0], 1 + np.flatnonzero(np.diff(part)), [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def word_hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mixed(left: np.ndarray, right: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of each ordered pair of 64-bit hashes."""
    x = (left * _AGAIN) ^ (right + _MIX)
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _AGAIN
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each text's words; 0 for a text without words."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Classes of a word's bytes: capitals, small letters, digits and other ASCII signs; bytes of other letters count as 4.
CAPITAL, SMALL, DIGIT, SIGN, OTHER = range(5)
BYTE_CLASS = np.array([CAPITAL if 65 <= b < 91 else SMALL if 97 <= b < 123 else DIGIT if 48 <= b < 58 else SIGN if b < 128 else OTHER for b in range(256)])


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all words one after the other."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a word's bytes are flagged."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def shape_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each word's byte classes with runs collapsed; signs count as themselves."""
    kinds = BYTE_CLASS[data]
    kinds = np.where(kinds == SIGN, 8 + data.astype(np.int64), kinds)
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[offsets[:-1][offsets[:-1] < len(kinds)]] = True
    rank = np.cumsum(new)
    starts = offsets[:-1][offsets[:-1] < len(kinds)]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[new]
    first = np.zeros(len(offsets) - 1, np.int64)
    first[np.flatnonzero(offsets[:-1] < len(kinds))] = rank[starts]
    value = mixed(kinds[new].astype(np.uint64), (rank[new] - first[owner]).astype(np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    ends = np.searchsorted(owner, np.arange(len(offsets)))
    return total[ends[1:]] - total[ends[:-1]]
