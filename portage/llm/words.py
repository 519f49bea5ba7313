"""Words, word hashes and word windows of many texts at once, with numpy on their UTF-8 bytes.

Everything here runs inside tasks and is sent to the executors by value. A chunk holds a few MB of text (or one longer
text), so memory is bounded by the chunk and the longest text, not by the partition.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 4 << 20
_WORD_BASE, _SECOND_BASE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
# Values of the 64-bit finaliser of MurmurHash3 (fixed values).
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every other."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(_MIX[0])
    values ^= values >> np.uint64(33)
    values *= np.uint64(_MIX[1])
    values ^= values >> np.uint64(33)
    return values


class Words:
    """The words of a list of texts: byte ranges ``starts``/``ends`` in ``raw``; text t has words first[t]:first[t+1].

    Words are runs of bytes other than space and 0x09-0x0D, after ``translation`` of each byte. None has no words.
    """

    def __init__(self, texts: list[bytes | None], translation: bytes | None = None):
        self.raw = (b"\n".join([text or b"" for text in texts]) + b"\n").translate(translation)
        data = np.frombuffer(self.raw, np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        self._solid = ~blank
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(text or b"") + 1 for text in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes))))
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._data = data

    def __len__(self) -> int:
        return len(self.starts)

    def coded(self) -> pa.DictionaryArray:
        """The words, each as a number into the distinct ones."""
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int32)
        letters = pa.py_buffer(self._data[self._solid])
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), letters]).dictionary_encode()

    def digests(self) -> np.ndarray:
        """Two rows of 64 bits, halves of a 128-bit BLAKE2 digest of each word's bytes; each distinct word is hashed once."""
        coded = self.coded()
        distinct = b"".join(hashlib.blake2b(word, digest_size=16).digest() for word in coded.dictionary.to_pylist())
        halves = np.frombuffer(distinct, np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(halves.T[:, coded.indices.to_numpy()])

    def hashes(self) -> np.ndarray:
        """The first halves. Sums of them over windows of some tens of words differ as random numbers do."""
        return self.digests()[0]

    def words(self, start: int, end: int) -> list[bytes]:
        return self.raw[self.starts[start]:self.ends[end - 1]].split()


_lower = [c + 32 if 65 <= c <= 90 else c for c in range(256)]
#: Lower-cases A-Z only.
LOWER = bytes(_lower)
#: Also makes a blank of every ASCII byte that is neither letter nor digit, so that words are letters, digits and bytes above 0x7F.
LOWER_ALNUM = bytes(c if c > 127 or bytes([c]).isalnum() else 32 for c in _lower)


def window_hashes(hashes: np.ndarray, size: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of each ``size`` consecutive words, also across texts; empty with fewer words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += hashes[i:i + n] * np.uint64(pow(base, i, 1 << 64))
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of the batches with about ``limit`` bytes of text, or one longer text, each; with the texts as bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, part.column(column).cast(pa.binary()).to_pylist()
