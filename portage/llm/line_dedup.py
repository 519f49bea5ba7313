"""Removal of repeated runs of lines by a suffix array over line ids.

Every line that is not blank is a symbol. Ranks of the suffixes by their first 1, 2, 4, ... lines come from prefix
doubling: a suffix's new rank orders the pair of its rank and the rank as many lines further on. Suffixes that share
their prefix with no other leave, so later rounds hold repeated lines only. Suffixes of equal rank at a depth are one
interval of the suffix array whose common prefix is at least as long, so two ranks give the interval of any depth.

A run of lines repeats if it has at least ``min_words`` words and stands at an earlier place too. Each line of such a
run lies in a shortest run of enough words that begins or ends somewhere in it and repeats with it; these have at most
``min_words`` lines. Looking up the intervals of all shortest runs therefore finds all lines of all maximal repeats, and
doubling stops at that depth.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portage.llm import words as W
from portage.llm.scratch import Scratch, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 20
_AT = ["doc_key", "text_key", "pos"]


def shortest_runs(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run with ``least`` words from each line on, and up to each line; 0 where there is none."""
    total = np.concatenate(([0], np.cumsum(counts)))
    n, at = len(counts), np.arange(len(counts))
    end = np.searchsorted(total, total[:-1] + least)
    ahead = np.where(end <= n, end - at, 0)
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    back = np.where(begin >= 0, at + 1 - begin, 0)
    return ahead, back


def list_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row per line that is not blank: its place among them, two halves of a 128-bit id, and its shortest runs."""
    for part, texts in W.chunks(batches):
        ids, doc, pos, ahead, back = [], [], [], [], []
        for d, text in enumerate(texts):
            lines = [line.split() for line in (text or b"").split(b"\n")]
            lines = [words for words in lines if words]
            if lines:
                ids += [hashlib.blake2b(b" ".join(words), digest_size=16).digest() for words in lines]
                doc.append(np.full(len(lines), d))
                pos.append(np.arange(len(lines)))
                runs = shortest_runs(np.fromiter(map(len, lines), np.int64, len(lines)), least)
                ahead.append(runs[0])
                back.append(runs[1])
        if ids:
            halves = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            d = np.concatenate(doc)
            columns = [part.column("doc_key").to_numpy()[d], part.column("text_key").to_numpy()[d],
                       np.concatenate(pos).astype(np.int32), halves[:, 0].copy(), halves[:, 1].copy(),
                       np.concatenate(ahead).astype(np.int32), np.concatenate(back).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_AT, "id_a", "id_b", "ahead", "back"])


def _ranked(suffixes: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """The suffixes that share ``by`` with others, with ``rank``, which orders ``by`` and is equal where they are.

    Distinct values are counted with a partial count, so a line that very many documents hold is one row, and ranks come
    from a range partitioning of these rows.
    """
    shared = suffixes.groupBy(*by).count().where("count > 1").select(*by)
    ordered = shared.repartitionByRange(*by).sortWithinPartitions(*by)
    ranks = scratch.stored(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return suffixes.join(ranks, by).drop(*by)


def suffix_ranks(lines: DataFrame, depth: int, scratch: Scratch) -> list[DataFrame]:
    """For 1, 2, 4, ... lines up to ``depth``: the suffixes that share so many first lines with others, ranked by them."""
    levels = [scratch.stored(_ranked(lines, ["id_a", "id_b"], scratch), "suffixes")]
    step = 1
    while step * 2 <= depth and not levels[-1].isEmpty():
        ahead = Window.partitionBy("doc_key", "text_key").orderBy("pos").rangeBetween(step, step)
        pairs = levels[-1].select(*_AT, F.col("rank").alias("first"), F.max("rank").over(ahead).alias("second"))
        levels.append(scratch.stored(_ranked(pairs.where("second IS NOT NULL"), ["first", "second"], scratch), "suffixes"))
        step *= 2
    return levels


def _later_copies(levels: list[DataFrame]) -> DataFrame:
    """doc_key, text_key, start and end of the shortest runs of enough words that also stand at an earlier place."""
    first = levels[0]
    runs = first.where("ahead > 0").selectExpr("doc_key", "text_key", "pos AS start", "ahead AS length").union(
        first.where("back > 0").selectExpr("doc_key", "text_key", "pos - back + 1", "back")).distinct()
    named = None
    for k, level in enumerate(levels):
        own = runs.where((F.col("length") >= 2**k) & (F.col("length") < 2 ** (k + 1)))
        ranks = level.select("doc_key", "text_key", "pos", "rank")
        head = own.join(ranks.withColumnsRenamed({"pos": "start", "rank": "head"}), ["doc_key", "text_key", "start"])
        head = head.withColumn("pos", F.col("start") + F.col("length") - 2**k)
        both = head.join(ranks.withColumnRenamed("rank", "tail"), _AT) if k else head.withColumn("tail", F.col("head"))
        both = both.select("doc_key", "text_key", "start", "length", "head", "tail")
        named = both if named is None else named.union(both)
    interval = ["length", "head", "tail"]
    firsts = named.groupBy(*interval).agg(F.min(F.struct("doc_key", "start")).alias("first"), F.count("*").alias("n"))
    later = named.join(firsts.where("n > 1").drop("n"), interval).where(F.struct("doc_key", "start") > F.col("first"))
    return later.select("doc_key", "text_key", "start", (F.col("start") + F.col("length")).alias("end"))


def drop_runs(batches: Iterator[pa.RecordBatch], with_counts: bool) -> Iterator[pa.RecordBatch]:
    """Rows without the lines under their runs (the last column); all other lines and columns stay as they are.

    With counts, every row comes with its lines and removed lines; without, a row that loses all its lines goes.
    """
    for part, texts in W.chunks(batches):
        counts, removed, kept_texts = [], [], []
        for text, runs in zip(texts, part.columns[-1].to_pylist()):
            lines = (text or b"").split(b"\n")
            solid = [bool(line.strip(b" \t\r\v\f")) for line in lines]
            counts.append(sum(solid))
            removed.append(0)
            if runs:
                gone = np.zeros(counts[-1] + 1, np.int32)
                np.add.at(gone, [r["start"] for r in runs], 1)
                np.add.at(gone, [r["end"] for r in runs], -1)
                bad = iter((np.cumsum(gone[:-1]) > 0).tolist())
                kept = [line for line, s in zip(lines, solid) if not (s and next(bad))]
                removed[-1] = len(lines) - len(kept)
                text = b"\n".join(kept)
            kept_texts.append(text)
        texts = pa.array(kept_texts, pa.binary()).cast(pa.string())
        names = part.schema.names[:-1]
        columns = [texts if name == "text" else part.column(name) for name in names]
        if with_counts:
            names = [*names, "n_lines", "n_removed"]
            columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        batch = pa.RecordBatch.from_arrays(columns, names=names)
        emptied = [bool(r) and r == n for r, n in zip(removed, counts)]
        yield batch if with_counts else batch.filter(pa.array([not e for e in emptied], pa.bool_()))


def _keys(doc_id, text) -> tuple:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63))), F.xxhash64(text)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_key, text_key and an array of runs (start and end among the lines that aren't blank), as a stored table."""
    scratch = Scratch(docs.sparkSession)
    doc_key, text_key = _keys(F.col("doc_id"), F.col("text"))
    lines = scratch.stored(docs.select(doc_key.alias("doc_key"), text_key.alias("text_key"), "text").mapInArrow(
        lambda batches: list_lines(batches, min_words),
        "doc_key long, text_key long, pos int, id_a long, id_b long, ahead int, back int",
    ), "lines")
    copies = _later_copies(suffix_ranks(lines, min_words, scratch)).distinct()
    runs = stored(copies.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "runs")
    scratch.clear()
    return runs


def _with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with their runs as the last column; matched by attributes, so names cannot clash.

    Sorted on both sides at every size: runs that are few enough to broadcast at one size are not at another.
    """
    doc_key, text_key = _keys(docs["doc_id"], docs["text"])
    same = (doc_key == runs["doc_key"]) & (text_key == runs["text_key"])
    return docs.join(runs.hint("merge"), same, "left").select(*(docs[name] for name in docs.columns), runs["runs"].alias("_runs_of_text"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (what is kept of it), n_lines and n_removed of every document.

    Lines end at a line feed and are equal if their words are; blank lines are not counted, compared or removed. A line
    goes if a run of lines around it, with at least ``min_words`` words, also stands at a smaller doc_id (null is
    smallest) or further ahead in the same document. Runs are judged on the input. Rows that repeat a document share
    their places, so neither is a copy of the other. A null text stays null. Other columns are not read. A doc_id of
    text has to hold a whole number.
    """
    narrow = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_runs(narrow, repeated_runs(docs, min_words)).mapInArrow(
        lambda batches: drop_runs(batches, True), f"doc_id {kind}, text string, n_lines long, n_removed long"
    )


def keep_first_copies_of_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without their later copies of lines, with the columns they had; one left with no line goes.

    ``n_chars``, where there is such a column, becomes the new length.
    """
    with_runs = _with_runs(docs, repeated_runs(docs, min_words))
    kept = with_runs.mapInArrow(lambda batches: drop_runs(batches, False), docs.schema)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept
