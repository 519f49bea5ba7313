"""Benchmark passages in training documents, through a positional inverted index of the documents.

The index is partitioned by document: a segment holds a few MB of texts with the postings of every token. A search
reads segments one by one, keeps test windows all of whose terms the segment has, and intersects offset-adjusted posting
lists from the rarest term on. Neither building nor searching shuffles. Test items are sent to the tasks in blocks of
bounded size, one pass over the index for each block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.llm import packed as P
from portage.llm import words as W
from portage.llm.scratch import LARGE_ROWS, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 10
#: Words that a proximity match may have between those of its window.
SLOP = 2
#: Bytes of test items that go to the tasks at once.
BLOCK_BYTES = 2 << 20
_INDEX = (
    "segment string, doc_ids array<{id}>, doc_starts array<int>, "
    "terms binary, counts binary, gaps binary"
)
_SPANS = "array<struct<item_id: string, start: bigint, end: bigint>>"
_FOUND = "segment string, ordinal int, doc_id {id}, n_words long, spans " + _SPANS + ", phrases " + _SPANS
_SPAN_LIST = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


# Index ---------------------------------------------------------------------------------------------------------------


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per few MB of texts: documents, where each begins, and packed the terms, list lengths, and positions as gaps."""
    partition = TaskContext.get().partitionId()
    for number, (part, texts) in enumerate(W.chunks(batches)):
        w = W.Words(texts, W.LOWER_ALNUM)
        coded = w.coded()
        numbers = coded.indices.to_numpy()
        order = np.argsort(numbers, kind="stable")
        counts = np.bincount(numbers, minlength=len(coded.dictionary))
        heads = np.cumsum(counts) - counts
        gaps = np.diff(order, prepend=0)
        gaps[heads] = order[heads]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{partition}-{number}"]), _one_list(part.column("doc_id")), _one_list(w.first, pa.int32()),
             *(pa.array([packed], pa.binary()) for packed in (P.pack_words(coded.dictionary), P.pack(counts), P.pack(gaps)))],
            names=["segment", "doc_ids", "doc_starts", "terms", "counts", "gaps"],
        )


def _one_list(values, kind: pa.DataType | None = None) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    values = values.cast(kind) if kind else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``doc_id`` and ``text``, as a stored table. Null texts are documents of no tokens."""
    schema = _INDEX.format(id=docs.schema["doc_id"].dataType.simpleString())
    return stored(docs.select("doc_id", "text").mapInArrow(segments, schema), "positions", **LARGE_ROWS)


# Search --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TestWindows:
    """Distinct windows of test items: terms by number (-1 fills up short ones) and the items that hold each."""

    terms: list[bytes]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def test_windows(items: list[tuple[str, bytes | None]], width: int) -> TestWindows:
    """Each ``width`` consecutive words of an item; an item of fewer words, but not none, is one window."""
    w = W.Words([text for _, text in items], W.LOWER_ALNUM)
    coded = w.coded()
    terms, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    holders: dict[tuple, set] = {}
    for (item, _), a, b in zip(items, w.first[:-1].tolist(), w.first[1:].tolist()):
        for start in range(a, max(b - width, a) + 1 if b > a else a):
            holders.setdefault(tuple(number[start:min(start + width, b)].tolist()), set()).add(item)
    windows = np.full((len(holders), width), -1, np.int32)
    for i, window in enumerate(holders):
        windows[i, :len(window)] = window
    lengths = np.array([len(window) for window in holders], np.int32)
    return TestWindows(terms, windows, lengths, [sorted(held) for held in holders.values()])


class _Segment:
    """Posting lists of the test terms in one segment; ``at[t]`` is the number of test term t here, or -1."""

    def __init__(self, row: pa.RecordBatch, tests: TestWindows):
        terms, counts, self.gaps = (
            unpack(row.column(name)[0].as_buffer())
            for name, unpack in (("terms", P.unpack_words), ("counts", P.unpack), ("gaps", P.unpack))
        )
        self.doc_ids, self.first = row.column("doc_ids").flatten(), row.column("doc_starts").flatten().to_numpy()
        counts = counts.astype(np.int64)
        self.heads = np.concatenate(([0], np.cumsum(counts)))
        number = pc.index_in(terms, value_set=pa.array(tests.terms, pa.binary()))
        here = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
        self.at = np.full(len(tests.terms), -1, np.int64)
        self.at[number.drop_null().to_numpy()] = here
        sizes = np.zeros(len(tests.terms), np.int64)
        sizes[self.at >= 0] = counts[self.at[self.at >= 0]]
        self.size = sizes.tolist()
        self.lists: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        if term not in self.lists:
            n = self.at[term]
            self.lists[term] = np.cumsum(self.gaps[self.heads[n]:self.heads[n + 1]], dtype=np.int64)
        return self.lists[term]

    def complete(self, tests: TestWindows) -> np.ndarray:
        """Test windows all of whose terms occur in this segment."""
        here = np.append(self.at >= 0, True)  # the last one stands for the filling
        return np.flatnonzero(here[tests.windows].all(axis=1))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1


def phrase_starts(segment: _Segment, window: list[int]) -> np.ndarray:
    """Positions where the words of ``window`` stand one after the other in one document."""
    starts = None
    for offset in sorted(range(len(window)), key=lambda i: segment.size[window[i]]):
        moved = segment.positions(window[offset]) - offset
        if starts is None:
            starts = moved
        else:
            at = np.minimum(moved.searchsorted(starts), len(moved) - 1)
            starts = starts[moved[at] == starts]
        if not len(starts):
            return starts
    return starts[segment.doc_of(starts) == segment.doc_of(starts + len(window) - 1)]


def proximity_spans(segment: _Segment, window: list[int], reach: int) -> list[tuple[int, int]]:
    """Shortest ranges of at most ``reach`` words of one document that hold every term of ``window``, in any order."""
    terms = sorted(set(window), key=segment.size.__getitem__)
    rarest = segment.positions(terms[0])
    for term in terms[1:]:
        other = segment.positions(term)
        rarest = rarest[other.searchsorted(rarest - reach + 1) < other.searchsorted(rarest + reach - 1, side="right")]
        if not len(rarest):
            return []
    spans = set()
    for position in rarest.tolist():
        lo, hi = position - reach + 1, position + reach - 1
        marks = []
        for term in terms:
            held = segment.positions(term)
            marks += [(p, term) for p in held[np.searchsorted(held, lo):np.searchsorted(held, hi, side="right")].tolist()]
        marks.sort()
        newest: dict[int, int] = {}
        for p, term in marks:
            newest[term] = p
            if len(newest) == len(terms):
                start = min(newest.values())
                if p - start < reach and start <= position <= p:
                    spans.add((start, p + 1))
    docs = [(segment.doc_of(np.array([a, b - 1])), a, b) for a, b in spans]
    inside = sorted((a, b) for (d, e), a, b in docs if d == e)
    return [(a, b) for a, b in inside if not any((c, d) != (a, b) and a <= c and d <= b for c, d in inside)]


def search_segments(
    batches: Iterator[pa.RecordBatch], tests: TestWindows, slop: int | None, phrases: bool, all_documents: bool
) -> Iterator[pa.RecordBatch]:
    """For each document its number of words and the spans (in words) that test items' windows match.

    With a ``slop`` these are proximity matches, which hold every exact one; ``phrases`` asks for the exact ones as well.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            segment = _Segment(row, tests)
            spans: list[list[dict]] = [[] for _ in range(len(segment.doc_ids))]
            exact: list[list[dict]] = [[] for _ in range(len(segment.doc_ids))]
            for number in segment.complete(tests).tolist():
                length = int(tests.lengths[number])
                window, items = tests.windows[number, :length].tolist(), tests.items[number]
                if slop is not None:
                    found = proximity_spans(segment, window, length + slop)
                    if not found:
                        continue
                    _add(spans, segment, found, items)
                if slop is None or phrases:
                    found = [(s, s + length) for s in phrase_starts(segment, window).tolist()]
                    _add(spans if slop is None else exact, segment, found, items)
            keep = [d for d in range(len(spans)) if all_documents or spans[d]]
            sizes = np.diff(segment.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row.column("segment").to_pylist() * len(keep), pa.string()), pa.array(keep, pa.int32()),
                 segment.doc_ids.take(pa.array(keep, pa.int64())), pa.array(sizes[keep], pa.int64()),
                 pa.array([_joined(spans[d]) for d in keep], _SPAN_LIST),
                 pa.array([_joined(exact[d]) for d in keep], _SPAN_LIST)],
                names=["segment", "ordinal", "doc_id", "n_words", "spans", "phrases"],
            )


def _add(spans: list[list[dict]], segment: _Segment, found: list[tuple[int, int]], items: list[str]) -> None:
    for start, end in found:
        doc = int(segment.doc_of(np.array([start]))[0])
        base = int(segment.first[doc])
        spans[doc] += [{"item_id": item, "start": start - base, "end": end - base} for item in items]


def _joined(spans: list[dict]) -> list[dict]:
    """Overlapping or touching spans of one item as one."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: (s["item_id"], s["start"], s["end"])):
        if out and out[-1]["item_id"] == span["item_id"] and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(span)
    return out


def benchmark_matches(
    index: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int | None = None, phrases: bool = False
) -> DataFrame:
    """segment, ordinal, doc_id, n_words, spans and phrases (item_id, start, end in words) for every document of the index.

    ``slop`` None gives exact phrases as ``spans``. A number gives proximity: all distinct terms of a window, in any order,
    within its length plus ``slop`` words of one document; the exact ones among them are in ``phrases`` if that is asked,
    which is empty otherwise. Items that are null or have no words match nothing; items of equal text all match. Item ids are
    text. The benchmark's items are dealt to blocks by a hash of their id. With more than one block, each block's matches
    are stored before the next is fetched, so the driver holds one block at a time.
    """
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        texts = own.select("item_id", F.col("text").cast("binary")).collect()
        tests = test_windows([(r[0], bytes(r[1]) if r[1] is not None else None) for r in texts], width)
        some = index.mapInArrow(
            lambda batches, tests=tests, every=block == 0: search_segments(batches, tests, slop, phrases, every),
            _FOUND.format(id=id_type),
        )
        if blocks == 1:
            return some
        some = stored(some, "matches")
        found = some if found is None else found.union(some)
    return found.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("phrases")).alias("phrases"),
    )


# Per document --------------------------------------------------------------------------------------------------------


def words_under(spans: Column) -> Column:
    """Number of words under any of the spans."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(ordered, zero, lambda done, s: F.struct(
        F.greatest(done["reach"], s["end"]).alias("reach"),
        (done["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(done["reach"], s["start"]))).alias("n"),
    ), lambda done: done["n"])


def _items(spans: str) -> Column:
    return F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["item_id"])))


def contaminated_documents(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int | None = None
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), spans, contaminated, near_items and near for every document.

    Words are lower-cased letters, digits and characters beyond ASCII. A word is hit inside any exact occurrence of
    ``width`` consecutive item words; ``contaminated`` goes by these alone. ``near_items`` and ``near`` are proximity
    matches of ``slop`` (empty without one), which every exact match is too. Null and empty texts have no words;
    repeated rows are reported each.
    """
    found = benchmark_matches(build_index(docs), benchmark, width, slop, phrases=slop is not None)
    exact, near = ("spans", "phrases") if slop is None else ("phrases", "spans")
    return found.select(
        "doc_id", "n_words", words_under(F.col(exact)).alias("n_hit"), _items(exact).alias("items"),
        F.col(exact).alias("spans"), _items(near).alias("near_items"), F.col(near).alias("near"),
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        (F.col("n_hit") > 0).alias("contaminated"), "near_items", "near",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that hold no benchmark window, with the columns they had; matched by doc_id, null included."""
    bad = contaminated_documents(docs, benchmark, width).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]), "left_anti")
