"""Fill-in-middle transformation: texts are cut at tokens and their middle part moves to the end.

Tokens are counted and found on machine words. The UTF-8 bytes of a chunk of texts are seen as 64-bit words of eight bytes.
Arithmetic on all eight bytes at once marks the bytes on which a token ends, one population count per word gives running
totals, and the k-th token's end is found by a search in the totals for its word and a byte-wise comparison in that word.
Code points are counted in the same way, from marks on the bytes that begin one.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.llm import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
#: Percent of the texts that are transformed, and of these with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def blank_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a space or 0x09-0x0D."""
    # Low halves stay below 0x80, so no sum carries into the next byte.
    low = words & _LOW7
    tab_to_return = (low + _ONES * np.uint64(0x80 - 0x09)) & ~(low + _ONES * np.uint64(0x80 - 0x0E))
    space = ~((low ^ (_ONES * np.uint64(0x20))) + _LOW7)
    return (tab_to_return | space) & ~words & _HIGH


class Marks:
    """Marked bytes of an array of words: how many there are before a byte, and where the k-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes in front of each byte position."""
        word, inside = at >> 3, ((at & 7) << 3).astype(np.uint64)
        part = self.marks[word] & ((np.uint64(1) << inside) - np.uint64(1))
        return np.where(word > 0, self.upto[word - 1], 0) + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the k-th mark, from 1; any position where there is no such mark."""
        word = np.minimum(np.searchsorted(self.upto, k), len(self.upto) - 1)
        rest = (k - np.where(word > 0, self.upto[word - 1], 0)).astype(np.uint64)
        # Each byte of the product holds the marks up to it; those with fewer than ``rest`` come before the place.
        running = (self.marks[word] >> np.uint64(7)) * _ONES
        fewer = ((((rest - np.uint64(1)) * _ONES) | _HIGH) - running) & _HIGH
        return (word << 3) + np.bitwise_count(fewer)


def as_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another as 64-bit words, padded with at least one blank, and the byte where each begins."""
    bounds = np.concatenate(([0], np.cumsum([len(text) for text in texts], dtype=np.int64)))
    raw = b"".join(texts)
    return np.frombuffer(raw + b" " * (16 - len(raw) % 8), "<u8"), bounds


def token_ends(words: np.ndarray, bounds: np.ndarray) -> Marks:
    """Bytes that end a token: the last byte of a text, and any other that is not blank and has a blank after it."""
    blank = blank_bytes(words)
    following = blank >> np.uint64(8)
    following[:-1] |= blank[1:] << np.uint64(56)
    marks = ~blank & following & _HIGH
    last = bounds[1:][np.diff(bounds) > 0] - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
    return Marks(marks)


def code_points(words: np.ndarray) -> Marks:
    """Bytes that begin a code point: all but those of the form 10xxxxxx."""
    return Marks((~words | (words << np.uint64(1))) & _HIGH)


def draws(doc_ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each document, from its id alone; a null id counts as an empty string."""
    heads = (hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_ids)
    return np.frombuffer(b"".join(heads), ">u4").reshape(-1, 4).astype(np.int64)


def transform(batches: Iterator[pa.RecordBatch], seed: int, rate: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, form, prefix_chars, middle_chars and output of each text."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for part, texts in W.chunks(batches):
        texts = [text or b"" for text in texts]
        words, bounds = as_words(texts)
        ends, starts = token_ends(words, bounds), bounds[:-1]
        before = ends.before(bounds)
        n = np.diff(before)
        h = draws(part.column("doc_id").to_pylist(), seed)
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        a, b = (np.where(k > 0, ends.select(np.maximum(before[:-1] + k, 1)) + 1, starts)
                for k in (np.minimum(one, two), np.maximum(one, two)))
        points = code_points(words)
        prefix_chars, middle_chars = (points.before(y) - points.before(x) for x, y in ((starts, a), (a, b)))
        plain = (n == 0) | (h[:, 2] % 100 >= rate)
        plain |= np.fromiter((any(m in text for m in marks) for text in texts), bool, len(texts))
        spm = h[:, 3] % 100 < suffix_first
        outputs, forms = [], []
        for text, is_plain, is_spm, x, y in zip(texts, plain.tolist(), spm.tolist(), (a - starts).tolist(), (b - starts).tolist()):
            p, m, s = text[:x], text[x:y], text[y:]
            forms.append(PLAIN if is_plain else SPM if is_spm else PSM)
            parts = (marks[1], s, marks[0], p, marks[2], m) if is_spm else (marks[0], p, marks[1], s, marks[2], m)
            outputs.append(text if is_plain else b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n), pa.array(forms), pa.array(prefix_chars, mask=plain),
             pa.array(middle_chars, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every document.

    A token is a run of blanks (space, 0x09-0x0D) with the word after it, or blanks at a text's end. Where a text is cut,
    and its form, depend on ``seed``, its doc_id and its number of tokens alone, so a task that runs again gives the same
    rows, and repeated rows agree. A null text is an empty one, and an empty text, or one that holds a mark, stays as it
    is (``plain``, with null counts). A null doc_id draws as an empty string would. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: transform(batches, seed, rate, suffix_first),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text with a mark is ever cut, so each mark stands once."""
    def between(start: str, end: str | None) -> Column:
        after = F.substring_index(output, start, -1)
        return F.substring_index(after, end, 1) if end else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
