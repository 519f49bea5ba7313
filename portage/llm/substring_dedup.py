"""Removal of repeated word passages by super-k-mers.

A window is ``width`` consecutive words. Consecutive windows whose smallest ``minimiser``-gram is the same travel as one
packed string to the bucket of that minimiser, so equal windows meet in one bucket while most words travel about three
times instead of ``width`` times. There, sorting brings equal windows together. Copies within one chunk are settled
before the shuffle, so a passage in a third of all documents sends one string per chunk.

Grams that a bounded sample of the documents holds very often come last in the order of minimisers: a window takes one only
if all its grams are such. So the windows around a common phrase, which differ by what stands beside it, go to the buckets
of their rarer grams and not all to one.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portage.llm import words as W
from portage.llm.scratch import input_bytes, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 20
MINIMISER = 4
#: Estimated bytes of input for each bucket. It sets the size of a bucket, not the result.
BUCKET_INPUT_BYTES = 4 << 20
#: Also used where the planner knows no size.
MOST_BUCKETS = 1 << 20
#: Estimated bytes of the sample, and the share of its grams from which a gram is common. Both set sizes of buckets only.
SAMPLE_BYTES = 16 << 20
COMMON_SHARE = 1 / 4096
_UNKNOWN = 1 << 60
_RUNS, _COVERS = 0, 1
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("packed", pa.binary())])
_COVER = pa.schema([("doc_key", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _same_words(w: W.Words, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether windows a[i] and b[i] have the same words; stretches that move on together are compared as one."""
    same = np.ones(len(a), bool)
    if not len(a):
        return same
    breaks = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
    for lo, hi in zip([0, *breaks.tolist()], [*breaks.tolist(), len(a)]):
        length = hi - lo + width - 1
        if w.words(a[lo], a[lo] + length) != w.words(b[lo], b[lo] + length):
            for i in range(lo, hi):
                same[i] = w.words(a[i], a[i] + width) == w.words(b[i], b[i] + width)
    return same


def _with_earlier_copy(w: W.Words, at: np.ndarray, place: np.ndarray, hashes: np.ndarray, width: int):
    """For each window: whether an equal one has an earlier place. ``at`` is ordered by place; equal places are not
    earlier. Second result: windows whose hash equals that of other words, which the first says nothing about.
    """
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ordered[1:] != ordered[:-1])), np.arange(len(order)), 0))
    first = np.empty(len(order), np.int64)
    first[order] = order[head]
    copies = np.flatnonzero((place[first] != place) & (first != np.arange(len(order))))
    same = _same_words(w, at[copies], at[first[copies]], width)
    repeated = np.zeros(len(at), bool)
    repeated[copies[same]] = True
    return repeated, copies[~same]


def _merged(at: np.ndarray, text_of: np.ndarray, width: int):
    """First and last window of each stretch of consecutive windows of one text."""
    if not len(at):
        return at, at
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(text_of[at]) != 0))
    return at[np.concatenate(([0], breaks + 1))], at[np.concatenate((breaks, [len(at) - 1]))]


def _pack(fields: list[np.ndarray], text: bytes = b"") -> bytes:
    sizes = np.array([len(fields[0]), *(f.dtype.itemsize for f in fields)], np.int64)
    return zstandard.ZstdCompressor(1).compress(b"".join([sizes.tobytes(), *(f.tobytes() for f in fields), text]))


def _unpack(packed: bytes, fields: int) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n, *widths = np.frombuffer(data, np.int64, fields + 1).tolist()
    at, out = 8 * (fields + 1), []
    for width in widths:
        out.append(np.frombuffer(data, f"i{width}", n, at).astype(np.int64))
        at += n * width
    return out, data[at:]


def _place_numbers(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers that are equal exactly where (doc, start) are equal, for arrays ordered by them."""
    return np.cumsum(np.concatenate(([0], (np.diff(doc) != 0) | (np.diff(start) != 0))))


def count_grams(batches: Iterator[pa.RecordBatch], minimiser: int) -> Iterator[pa.RecordBatch]:
    """gram and its number for those that are common in a chunk of text, or nearly; and with a null gram, all of them."""
    for _, texts in W.chunks(batches):
        w = W.Words(texts)
        grams, counts = np.unique(W.window_hashes(w.hashes(), minimiser), return_counts=True)
        total = int(counts.sum())
        often = counts >= max(2, total * COMMON_SHARE / 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *grams[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[often].tolist()], pa.int64())],
            names=["gram", "n"],
        )


def common_grams(docs: DataFrame, minimiser: int = MINIMISER) -> np.ndarray:
    """Sorted hashes of the grams that have at least ``COMMON_SHARE`` of all in a sample; ``1 / COMMON_SHARE`` at most."""
    size = input_bytes(docs)
    if size >= _UNKNOWN:  # the planner knows no size
        size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 1
    part = docs.select("text").sample(fraction=min(1.0, SAMPLE_BYTES / max(size, 1)), seed=1)
    counted = part.mapInArrow(lambda batches: count_grams(batches, minimiser), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = stored(counted, "grams")
    total = counted.where("gram IS NULL").agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("gram").isNotNull() & (F.col("n") >= max(total * COMMON_SHARE, 2)))
    return np.sort(np.array([row["gram"] for row in often.collect()], np.int64).view(np.uint64))


def _order_of_grams(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Numbers by which the minimiser is chosen: common grams have the highest bit, others come first."""
    there = np.zeros(len(grams), np.uint64)
    if len(common):
        there[common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams] = 1
    return (grams >> np.uint64(1)) | (there << np.uint64(63))


def _runs_of_chunk(part: pa.RecordBatch, texts: list, width: int, minimiser: int, buckets: int, common: np.ndarray):
    doc_key = part.column("doc_key").to_numpy()
    by_doc = np.argsort(doc_key, kind="stable")
    doc_key, text_key = doc_key[by_doc], part.column("text_key").to_numpy()[by_doc]
    w = W.Words([texts[i] for i in by_doc.tolist()])
    if len(w) < width:
        return
    hashes = w.hashes()
    at = np.flatnonzero(w.text_of[:len(w) - width + 1] == w.text_of[width - 1:])
    if not len(at):
        return
    least = W.sliding_min(_order_of_grams(W.window_hashes(hashes, minimiser), common), width - minimiser + 1)[at]
    text_of = w.text_of[at]
    doc, start = doc_key[text_of], at - w.first[text_of]
    # repeated rows of one document interleave; order by place
    by_place = np.lexsort((start, doc))
    if len(np.unique(doc_key)) == len(doc_key):
        by_place = np.arange(len(at))
    repeated = np.empty(len(at), bool)
    flags, _ = _with_earlier_copy(
        w, at[by_place], _place_numbers(doc[by_place], start[by_place]),
        W.window_hashes(hashes, width)[at[by_place]], width,
    )
    repeated[by_place] = flags
    lo, hi = _merged(at[repeated], w.text_of, width)
    if len(lo):
        t = w.text_of[lo]
        covers = _pack([doc_key[t], text_key[t], lo - w.first[t], hi - w.first[t] + width])
        yield int(doc_key[t[0]] % buckets), _COVERS, covers

    keep = ~repeated
    at, least, text_of = at[keep], least[keep], text_of[keep]
    if not len(at):
        return
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(text_of) != 0) | (least[1:] != least[:-1])))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(at)])) - 1
    bucket = (W.mix(least[head]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    head, tail, bucket = head[order], tail[order], bucket[order]
    t = text_of[head]
    doc, text, start = doc_key[t], text_key[t], (at[head] - w.first[t])
    strings = [w.raw[a:b] for a, b in zip(w.starts[at[head]].tolist(), w.ends[at[tail] + width - 1].tolist())]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    sizes = np.fromiter(map(len, strings), np.int32, len(strings))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(bucket[a]), _RUNS, _pack([doc[a:b], text[a:b], start[a:b], sizes[a:b]], b"".join(strings[a:b]))


def pack_super_kmers(batches: Iterator[pa.RecordBatch], width: int, minimiser: int, buckets: int, common: np.ndarray):
    for part, texts in W.chunks(batches):
        rows = list(_runs_of_chunk(part, texts, width, minimiser, buckets, common))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)], schema=_PACKED)


def covers_of_bucket(table: pa.Table, width: int) -> pa.Table:
    """Word ranges covered by windows that start earlier elsewhere, for all strings of one bucket."""
    fields, strings, found = [], [], []
    for kind, packed in zip(table.column("kind").to_pylist(), table.column("packed").to_pylist()):
        if kind == _COVERS:
            found.append(pa.table(_unpack(packed, 4)[0], schema=_COVER))
            continue
        (doc, text, start, sizes), data = _unpack(packed, 4)
        ends = np.cumsum(sizes)
        strings += [data[b - n:b] for n, b in zip(sizes.tolist(), ends.tolist())]
        fields.append((doc, text, start))
    if fields:
        found.append(_covers_of_runs(fields, strings, width))
    return pa.concat_tables(found)


def _covers_of_runs(fields: list[tuple], strings: list[bytes], width: int) -> pa.Table:
    doc, text, start = (np.concatenate(column) for column in zip(*fields))
    order = np.lexsort((start, doc))
    doc, text, start = doc[order], text[order], start[order]
    w, hashes, at = _hashed_runs([strings[i] for i in order.tolist()], width)
    run = w.text_of[at]
    place_doc, place_start = doc[run], start[run] + at - w.first[run]
    by_place = np.lexsort((place_start, place_doc))
    repeated = np.zeros(len(at), bool)
    flags, unsettled = _with_earlier_copy(
        w, at[by_place], _place_numbers(place_doc[by_place], place_start[by_place]), hashes[by_place], width
    )
    repeated[by_place] = flags
    if len(unsettled):  # one hash for different words: compare those windows as words
        clash = np.isin(hashes, hashes[by_place[unsettled]])
        seen: dict[tuple, tuple] = {}
        for i in by_place.tolist():
            if clash[i]:
                place = (place_doc[i], place_start[i])
                repeated[i] = seen.setdefault(tuple(w.words(at[i], at[i] + width)), place) < place
    lo, hi = _merged(at[repeated], w.text_of, width)
    r = w.text_of[lo]
    begin = start[r] - w.first[r]
    return pa.table([doc[r], text[r], begin + lo, begin + hi + width], schema=_COVER)


def _hashed_runs(strings: list[bytes], width: int):
    """All strings' words, with the hash and word index of each window; hashed a few MB at a time."""
    w = W.Words(strings)
    sizes = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings))) // W.CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(strings)]
    hashes, places = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = W.Words(strings[a:b])
        at = np.flatnonzero(part.text_of[:max(0, len(part) - width + 1)] == part.text_of[width - 1:])
        hashes.append(W.window_hashes(part.hashes(), width)[at])
        places.append(at + w.first[a])
    return w, np.concatenate(hashes), np.concatenate(places)


def drop_covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its kept words joined by one space."""
    for part, texts in W.chunks(batches):
        counts, removed, kept_texts = [], [], []
        for text, covers in zip(texts, part.column("covers").to_pylist()):
            words = (text or b"").split()
            counts.append(len(words))
            if covers:
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, [c["start"] for c in covers], 1)
                np.add.at(gone, [c["end"] for c in covers], -1)
                keep = np.cumsum(gone[:-1]) == 0
                words = [word for word, k in zip(words, keep.tolist()) if k]
            removed.append(counts[-1] - len(words))
            kept_texts.append(b" ".join(words))
        digests = [hashlib.sha256(text).hexdigest() for text in kept_texts]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests),
             pa.array(kept_texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_key"),
        F.xxhash64("text").alias("text_key"), "text",
    )


def repeated_ranges(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER) -> DataFrame:
    """doc_key, text_key, start, end: word ranges under windows that start earlier elsewhere; ranges may overlap."""
    buckets = min(max(16, -(-input_bytes(docs) // BUCKET_INPUT_BYTES)), MOST_BUCKETS)
    common = common_grams(docs, minimiser)
    packed = _keyed(docs).select("doc_key", "text_key", "text").mapInArrow(
        lambda batches: pack_super_kmers(batches, width, minimiser, buckets, common), "bucket int, kind byte, packed binary"
    )
    return packed.groupBy("bucket").applyInArrow(
        lambda table: covers_of_bucket(table, width), "doc_key long, text_key long, start long, end long"
    )


def drop_repeated_passages(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document.

    A word goes if a window over it also starts earlier: at a smaller doc_id (null is smallest) or further ahead in the
    same document. Repeated rows of one document share their places, so none is earlier than the other and all keep
    what the document keeps. A doc_id of text has to hold a whole number. Null or empty texts have no words; texts under ``width`` words have no window. Other
    columns are not read, so their names cannot clash.
    """
    covers = repeated_ranges(docs, width, minimiser).groupBy("doc_key", "text_key")
    covers = covers.agg(F.collect_list(F.struct("start", "end")).alias("covers"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _keyed(docs).join(covers, ["doc_key", "text_key"], "left").select("doc_id", "text", "covers")
    return joined.mapInArrow(
        drop_covered, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
