"""Ranked lexical search over an impact-sorted index, with no random access to it (NRA).

The index is a table of segments, each with the postings of some MB of whole texts. A term's postings are sorted
by what one occurrence in the query would add to a document's score, largest first. A search reads the lists of its terms
from the front, in blocks. What has been read of a document is the lower end of its score interval; the upper end adds,
for each list in which it has not been met, the value at which reading stands. Documents whose upper end lies below the
k-th lower end are out. Reading goes on until the intervals of all others are single numbers, so membership, ties and
final scores are settled in each segment, and the best of all segments are the best of all documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portage.llm import packed as P
from portage.llm import words as W
from portage.llm.scratch import LARGE_ROWS, Scratch, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 10
#: Text of a segment, and items whose terms take so many bytes are searched in one pass over the index.
SEGMENT_BYTES = 12 << 20
BLOCK_BYTES = 2 << 20
#: Postings of a list that the first round reads; later rounds read four times as many as the one before.
FIRST_READ = 256
#: A segment as it is stored: terms and numbers are packed.
_SEGMENT = "text_bytes long, n_docs long, n_terms long, doc_ids array<{}>, lengths binary, terms binary," \
    " counts binary, docs binary, {} binary"
#: Terms of a segment that go to Spark at once.
TERMS_AT_ONCE = 1 << 16


def blocks(text: bytes, limit: int = W.CHUNK_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes, cut at blanks only; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            if cut <= at:
                cut = text.find(b" ", end)
            end = cut if cut > 0 else len(text)
        yield text[at:end]
        at = end


def count_terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, and for each text and term in it: the text's number, the term's number, its occurrences."""
    raw = b" ".join(texts) + b" "
    data = np.frombuffer(raw, np.uint8)
    solid = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(text) + 1 for text in texts])
    text_of = np.searchsorted(bounds, starts, side="right")
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    coded = terms.dictionary_encode()
    distinct = max(len(coded.dictionary), 1)
    key, times = np.unique(text_of * distinct + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, key // distinct, key % distinct, times


class Postings:
    """Growing postings of one segment: documents with their lengths, and (document, term, occurrences)."""

    def __init__(self):
        self.size, self.n_docs = 0, 0
        self.ids, self.lengths, self.terms, self.parts = [], [], [], []

    def add(self, ids: pa.Array, lengths: np.ndarray, counted: list[tuple], size: int) -> None:
        """Documents with their postings in any number of parts: terms, and numbers of documents and terms among these."""
        for terms, doc, term, times in counted:
            known = np.int32(sum(map(len, self.terms)))
            self.terms.append(terms)
            self.parts.append((doc.astype(np.int32) + np.int32(self.n_docs), term.astype(np.int32) + known, times.astype(np.int32)))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.n_docs += len(ids)
        self.size += size

    def merged(self) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Document ids and lengths in the order of the ids, terms, and postings by term and document. Once only."""
        ids = pa.concat_arrays(self.ids)
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        doc, term, times = (np.concatenate(column) for column in zip(*self.parts))
        self.terms, self.parts = [], []
        key = coded.indices.to_numpy()[term].astype(np.int64) * len(ids) + place[doc]
        del doc, term
        by_key = np.argsort(key, kind="stable")
        key, times = key[by_key], times[by_key].astype(np.int64)
        del by_key
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        if not first.all():  # a text that was counted in parts has a term several times
            times = np.add.reduceat(times, np.flatnonzero(first))
            key = key[first]
        return ids.take(pa.array(order)), np.concatenate(self.lengths)[order], coded.dictionary, key % len(ids), key // len(ids), times

    def row(self, name: str, values) -> pa.RecordBatch:
        """The segment as one row; ``values`` gives each posting's value, and None or the order of postings in a list."""
        ids, lengths, terms, doc, term, times = self.merged()
        value = values(doc, term, times, lengths)
        if name == "impacts":
            # Terms stay together; of one term the largest value comes first, then the smaller document.
            order = np.argsort(term * (int(value.max(initial=0)) + 1) + (int(value.max(initial=0)) - value), kind="stable")
            doc, value = doc[order], value[order]
        one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
        columns = [
            pa.array([self.size]), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
            one(ids), pa.array([lengths.astype("<i8").tobytes()], pa.binary()), one(terms.cast(pa.string())),
            one(pa.array(np.bincount(term, minlength=len(terms)).astype(np.int32))),
            pa.array([doc.astype("<i4").tobytes()], pa.binary()), pa.array([value.astype("<i4").tobytes()], pa.binary()),
        ]
        names = ["text_bytes", "n_docs", "n_terms", "doc_ids", "lengths", "terms", "counts", "docs", name]
        return pa.RecordBatch.from_arrays(columns, names=names)


def packed_segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as they are stored, a row each."""
    for row in rows:
        name = row.schema.names[-1]
        docs, values = (np.frombuffer(row.column(n)[0].as_buffer(), "<i4") for n in ("docs", name))
        small = {
            "terms": P.pack_words(row.column("terms").flatten()), "counts": P.pack(row.column("counts").flatten().to_numpy()),
            "docs": P.pack(docs), name: P.pack(values),
        }
        yield pa.RecordBatch.from_arrays(
            [pa.array([small[n]], pa.binary()) if n in small else row.column(n) for n in row.schema.names], names=row.schema.names
        )


def terms_of(row: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray]:
    """Terms of a stored segment, and the number of postings of each."""
    return P.unpack_words(row.column("terms")[i].as_buffer()), P.unpack(row.column("counts")[i].as_buffer())


def postings_of(row: pa.RecordBatch, i: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Documents and values of a stored segment's postings."""
    return tuple(P.unpack(row.column(n)[i].as_buffer()) for n in ("docs", name))


def list_held_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term and holders, the number of its postings, of each term of each stored segment."""
    for batch in batches:
        for i in range(batch.num_rows):
            terms, counts = terms_of(batch, i)
            held = pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(counts)], names=["term", "holders"])
            for start in range(0, held.num_rows, TERMS_AT_ONCE):
                yield held.slice(start, TERMS_AT_ONCE)


def _occurrences(doc, term, times, lengths):
    return times


def _short_or_alone(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts: neighbours of at most a chunk's size together, and each longer text on its own."""
    start = 0
    for i, text in enumerate(texts):
        if len(text) > W.CHUNK_BYTES:
            if i > start:
                yield start, i
            yield i, i + 1
            start = i + 1
    if start < len(texts):
        yield start, len(texts)


def count_segments(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Segments with occurrences, from texts; at least one text each. A long text is counted in parts."""
    postings = Postings()
    for part, texts in W.chunks(batches):
        texts = [text or b"" for text in texts]
        for a, b in _short_or_alone(texts):
            some = [text.translate(W.LOWER_ALNUM) for text in texts[a:b]]
            counted = [count_terms(group) for group in ([some] if b - a > 1 else [[piece] for piece in blocks(some[0])] or [some])]
            lengths = sum(np.bincount(doc, times, b - a) for _, doc, _, times in counted).astype(np.int64)
            postings.add(part.column("doc_id").slice(a, b - a), lengths, counted, sum(map(len, some)))
            if postings.size >= segment_bytes:
                yield postings.row("times", _occurrences)
                postings = Postings()
    if postings.n_docs:
        yield postings.row("times", _occurrences)


def impacts(times: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence in a query of weight 1 adds for each posting, from the document's length in terms."""
    if 75 * int(lengths.max(initial=0)) * n_docs >= 1 << 63:
        shares = np.array([75 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    else:
        shares = 75 * lengths * n_docs // n_terms
    return 1_000_000_000 * times // (1000 * times + 8 * (100 - 75 + shares))


def sort_segments(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Segments with sorted impacts, from stored segments with occurrences; small ones are joined."""
    def values(doc, term, times, lengths):
        return impacts(times, lengths[doc], n_docs, n_terms)

    postings = Postings()
    for batch in batches:
        for i in range(batch.num_rows):
            size = batch.column("text_bytes")[i].as_py()
            if postings.n_docs and postings.size + size > segment_bytes:
                yield postings.row("impacts", values)
                postings = Postings()
            terms, counts = terms_of(batch, i)
            doc, times = postings_of(batch, i, "times")
            term = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            lengths = np.frombuffer(batch.column("lengths")[i].as_buffer(), "<i8")
            postings.add(batch.column("doc_ids")[i].values, lengths, [(terms, doc, term, times)], size)
    if postings.n_docs:
        yield postings.row("impacts", values)


def best_documents(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, top: int) -> list[tuple[int, int]]:
    """(document, score) of the ``top`` largest sums over the lists, equal ones by document; sums of 0 are left out.

    Each list has documents, values in falling order, and a factor. ``lower`` holds what has been read of a document,
    ``met`` the sum of the next values of those lists in which it has been met.
    """
    lower, met = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    at, following = 0, [0] * len(lists)
    step, left = FIRST_READ, np.arange(n_docs)
    while True:
        end = at + step
        for t, (docs, values, factor) in enumerate(lists):
            if at >= len(docs):
                continue
            after = int(values[end]) * factor if end < len(docs) else 0
            if following[t] != after:
                met[docs[:at]] += after - following[t]
            # A document stands once in a list, so no sum is lost here.
            fresh = docs[at:end]
            lower[fresh] += values[at:end].astype(np.int64) * factor
            if after:
                met[fresh] += after
            following[t] = after
        at, step = end, step * 4
        rest = sum(following)
        low = lower[left]
        least = int(np.partition(low, len(low) - top)[len(low) - top]) if len(low) > top else 0
        upper = low + (rest - met[left])
        inside = upper >= max(least, 1)
        left, low, upper = left[inside], low[inside], upper[inside]
        if np.array_equal(low, upper):
            break
    order = np.lexsort((left, -low))[:top]
    return list(zip(left[order].tolist(), low[order].tolist()))


def search_segments(batches: Iterator[pa.RecordBatch], items: list[tuple], top: int) -> Iterator[pa.RecordBatch]:
    """item_key, doc_id and score of each item's best documents of each stored segment."""
    vocabulary = sorted({term for _, terms, _ in items for term in terms})
    number = {term: i for i, term in enumerate(vocabulary)}
    for batch in batches:
        for i in range(batch.num_rows):
            doc_ids = batch.column("doc_ids")[i].values
            docs, values = postings_of(batch, i, "impacts")
            held, counts = terms_of(batch, i)
            ends = np.cumsum(counts, dtype=np.int64)
            there = pc.index_in(pa.array(vocabulary, pa.string()).cast(pa.binary()), held)
            place = pc.fill_null(there, -1).to_numpy(zero_copy_only=False)
            keys, found, scores = [], [], []
            for key, terms, factors in items:
                lists = []
                for term, factor in zip(terms, factors):
                    p = int(place[number[term]])
                    if p >= 0:
                        a, b = (int(ends[p - 1]) if p else 0), int(ends[p])
                        lists.append((docs[a:b], values[a:b], factor))
                for doc, score in best_documents(lists, len(doc_ids), top) if lists else ():
                    keys.append(key)
                    found.append(doc)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), doc_ids.take(pa.array(found, pa.int64())), pa.array(scores, pa.int64())],
                names=["item_key", "doc_id", "score"],
            )


def list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_key, term and occurrences of each item's text."""
    for part, texts in W.chunks(batches):
        terms, item, term, times = count_terms([(text or b"").translate(W.LOWER_ALNUM) for text in texts])
        yield pa.RecordBatch.from_arrays(
            [part.column("item_key").take(pa.array(item)), terms.cast(pa.string()).take(pa.array(term)), pa.array(times, pa.int64())],
            names=["item_key", "term", "times"],
        )


def build_index(docs: DataFrame, scratch: Scratch, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, int, int]:
    """Segments of sorted postings of every document, the number of documents with a term, and of all their terms.

    A null text has no terms. Every row is a document of its own. Texts are read once; the numbers, on which the order of
    the postings depends, come from the first, unsorted form.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = scratch.stored(docs.select("doc_id", "text").mapInArrow(
        lambda batches: packed_segments(count_segments(batches, segment_bytes)), _SEGMENT.format(kind, "times")
    ), "counted", **LARGE_ROWS)
    n_docs, n_terms, size = (n or 0 for n in counted.agg(F.sum("n_docs"), F.sum("n_terms"), F.sum("text_bytes")).first())
    # As many tasks as there will be segments, so that small ones meet; no row is shuffled.
    segments = counted.coalesce(max(1, -(-size // segment_bytes))).mapInArrow(
        lambda batches: packed_segments(sort_segments(batches, n_docs, n_terms, segment_bytes)), _SEGMENT.format(kind, "impacts")
    )
    return scratch.stored(segments, "index", **LARGE_ROWS), n_docs, n_terms


def weighted_items(items: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """item_key, and the terms that some document holds with a factor each: occurrences in the item times weight."""
    terms = items.select("item_key", "text").mapInArrow(list_terms, "item_key long, term string, times long")
    terms = terms.groupBy("item_key", "term").agg(F.sum("times").alias("times"))
    wanted = terms.select("term").distinct()
    held = index.select("terms", "counts").mapInArrow(list_held_terms, "term string, holders int")
    counts = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("holders").alias("holders"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("holders") + 1)))
    factors = terms.join(counts, "term").withColumn("factor", F.col("times") * weight).where("factor > 0")
    return factors.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct("term", "factor"))).alias("factors"))


def _blocks_of_items(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items as (key, terms, factors), so many at a time that their terms take about ``block_bytes``."""
    block, size = [], 0
    for row in items.toLocalIterator():
        terms = [f["term"] for f in row["factors"]]
        block.append((row["item_key"], terms, [f["factor"] for f in row["factors"]]))
        size += sum(len(term) + 16 for term in terms)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, segment_bytes: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents with a score above 0, best first.

    Terms are runs of ASCII letters, digits and bytes above 0x7F, with A-Z lower-cased. Equal scores go by doc_id, null
    first. Every row of either table is a document, or an item, of its own, so a repeated item has its ranks twice. Items
    without a text, or without a term that a document holds, have no rows. Other columns are not read.

    The driver holds the terms of one block of items at a time, and each block is one pass over the index.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    index, n_docs, _ = build_index(docs, scratch, segment_bytes)
    keyed = scratch.stored(items.select("item_id", "text", F.monotonically_increasing_id().alias("item_key")), "items")
    factors = scratch.stored(weighted_items(keyed, index, n_docs), "factors")
    schema = f"item_key long, doc_id {kind}, score long"
    found = spark.createDataFrame([], schema)
    for block in _blocks_of_items(factors, block_bytes):
        best = index.mapInArrow(lambda batches, block=block: search_segments(batches, block, top), schema)
        found = found.union(scratch.stored(best, "found"))
    order = Window.partitionBy("item_key").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    result = ranked.join(keyed.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score")
    result = stored(result, "ranked")
    scratch.clear()
    return result
