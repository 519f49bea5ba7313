"""Numbers and words as compressed bytes.

A row of an index that holds lists passes the JVM several times its size: as column vectors, rows and Arrow vectors that
double as they grow. As compressed bytes it is a fraction of that, and a task's rows are no larger there than on disk.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _squeezed(data) -> bytes:
    """The number of bytes, and these compressed."""
    data = memoryview(data)
    return data.nbytes.to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(squeezed) -> pa.Buffer:
    squeezed = pa.py_buffer(squeezed)
    size = int.from_bytes(squeezed.slice(0, 8).to_pybytes(), "little")
    return pa.decompress(squeezed.slice(8), decompressed_size=size, codec="zstd")


def pack(numbers: np.ndarray) -> bytes:
    """32-bit integers: the lowest bytes of all, then the next ones, since the higher bytes of most are alike."""
    return _squeezed(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).reshape(-1))


def unpack(packed) -> np.ndarray:
    planes = np.frombuffer(_whole(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def pack_words(words: pa.Array) -> bytes:
    """Words without nulls, as their sizes and their letters."""
    words = words.cast(pa.binary())
    ends, letters = np.zeros(1, np.int32), b""
    if len(words):
        _, offsets, letters = words.buffers()
        ends = np.frombuffer(offsets, "<i4")[words.offset:words.offset + len(words) + 1]
        letters = letters.slice(int(ends[0]), int(ends[-1] - ends[0])) if letters else b""
    sizes = pack(np.diff(ends))
    return len(sizes).to_bytes(8, "little") + sizes + _squeezed(letters)


def unpack_words(packed) -> pa.Array:
    """The words as binary values."""
    packed = pa.py_buffer(packed)
    size = int.from_bytes(packed.slice(0, 8).to_pybytes(), "little")
    ends = np.concatenate(([0], np.cumsum(unpack(packed.slice(8, size))))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), _whole(packed.slice(8 + size))])
