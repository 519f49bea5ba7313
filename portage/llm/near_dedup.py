"""Near-duplicate groups by an inverted join over MinHash signatures.

Documents with equal shingle sets are one class; only classes are compared. Each class posts itself under every
(coordinate, value) of its signature. Two classes are candidates when they agree in at least ``MATCHES`` of
``COORDINATES``. By the prefix principle such a pair shares one of each side's ``COORDINATES - MATCHES + 1`` rarest
lists, so the longest lists of a class (common lines and passages) are skipped without losing a pair, and a class whose
values are mostly its own posts nothing. Candidates are confirmed on their whole shingle sets.

Groups of many near copies are first joined through list leaders, which is linear in the lists. Pairs are then emitted
between different components only, which the remaining links need. They carry a sketch of one bit from each of
``SKETCH_BITS`` further coordinates, so pairs that are clearly less similar are not emitted at all, and their lists, so
a pair that meets in several is emitted in the first of them only.
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
from portage.llm.components import connected_components
from portage.llm.scratch import Scratch, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
COORDINATES = 64
#: A pair at similarity 0.75 agrees in 48 of 64 coordinates on average and in fewer than 32 about four times in a million.
MATCHES = 32
PERCENT = 75
#: At similarity 0.75 an eighth of the sketches' bits differ; the bound lies five standard deviations above.
#: With many more bits the join's condition no longer fits a method that the JVM compiles (8000 bytes).
SKETCH_BITS = 1536
LEADER_ROUNDS = 2
_SETS = "node long, signature array<int>, sketch array<long>, shingles array<long>, second_halves array<long>"
#: Bytes of text that a task hashes at once, or one longer text.
CHUNK_BYTES = 1 << 20
_NO_ID = 2**63 - 1  # stands for a null doc_id


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as 128-bit values, in two rows of 64 bits.

    They are made of strong digests of the words. A text of fewer words is one shingle, one of none has none.
    """
    w = W.Words(texts, W.LOWER)
    lanes, bases = w.digests(), (W._WORD_BASE, W._SECOND_BASE)
    windows = np.stack([W.window_hashes(lane, size, base) for lane, base in zip(lanes, bases)])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            own = windows[:, a:b - size + 1]
            own = own[:, np.lexsort(own[::-1])]
            new = np.ones(own.shape[1], bool)
            new[1:] = (own[:, 1:] != own[:, :-1]).any(axis=0)
            out.append(own[:, new])
        elif b > a:
            out.append(np.stack([W.window_hashes(lane[a:b], b - a, base) for lane, base in zip(lanes, bases)]))
        else:
            out.append(windows[:, :0])
    return out


def _coordinate_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = W.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] | np.uint64(1))[:, None], seeds[n:][:, None]


def signature_of(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minimum of each coordinate's hash over the set, as 32-bit values."""
    factor, shift = functions
    out = np.full(len(factor), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 8192):
        values = shingles[None, at:at + 8192] * factor
        values += shift
        np.minimum(out, values.min(axis=1) >> np.uint64(32), out=out)
    return out.astype(np.uint32).view(np.int32)


def sign(batches: Iterator[pa.RecordBatch], size: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    """Each document's signature and number of shingles, and a 128-bit digest of its whole set."""
    functions = _coordinate_functions(coordinates)
    for part, texts in W.chunks(batches, limit=CHUNK_BYTES):
        sets = shingle_sets(texts, size)
        digests = b"".join(hashlib.blake2b(np.ascontiguousarray(s).tobytes(), digest_size=16).digest() for s in sets)
        halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
        signatures = np.concatenate([signature_of(s[0], functions) for s in sets])
        offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("doc_key"), pa.array([s.shape[1] for s in sets], pa.int64()),
             pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(offsets, pa.array(signatures))],
            names=["doc_id", "doc_key", "n_shingles", "set_a", "set_b", "signature"],
        )


def sketch_of(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One bit of each coordinate's smallest hash over the set, 64 to a number."""
    factor, shift = functions
    least = np.full(len(factor), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        values = shingles[None, at:at + 512] * factor
        values += shift
        np.minimum(least, values.min(axis=1), out=least)
    bits = (W.mix(least) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def full_sets(batches: Iterator[pa.RecordBatch], size: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    functions = _coordinate_functions(coordinates)
    more = tuple(f[coordinates:] for f in _coordinate_functions(coordinates + SKETCH_BITS))
    for part, texts in W.chunks(batches, limit=CHUNK_BYTES):
        sets = shingle_sets(texts, size)
        yield pa.RecordBatch.from_arrays(
            [part.column("node"), pa.array([signature_of(s[0], functions) for s in sets], pa.list_(pa.int32())),
             pa.array([sketch_of(s[0], more) for s in sets], pa.list_(pa.int64())),
             *(pa.array([s[half].view(np.int64) for s in sets], pa.list_(pa.int64())) for half in (0, 1))],
            names=["node", "signature", "sketch", "shingles", "second_halves"],
        )


def _agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def confirmed(pairs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that agree in ``matches`` coordinates and whose whole sets are similar enough.

    Shingles count as common if both halves say so, so two that differ would have to agree in 128 bits.
    """
    columns = ("signature", "shingles", "second_halves")
    side_a, side_b = (sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")
    enough = _agreeing(F.col("signature_a"), F.col("signature_b")) >= matches
    both = F.least(*(F.size(F.array_intersect(f"{half}_a", f"{half}_b")) for half in ("shingles", "second_halves")))
    either = F.size("shingles_a") + F.size("shingles_b") - both
    # Sorted on both sides at every size: pairs that are few enough to broadcast at one size are not at another.
    return pairs.hint("merge").join(side_a, "a").hint("merge").join(side_b, "b").where(enough & (both * 100 >= either * percent)).select("a", "b")


def rarest_postings(signed: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(key, node): each class under its rarest lists, as many as the prefix principle needs."""
    value = F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(value)
    postings = signed.select("node", F.posexplode("signature").alias("coordinate", "value")).select("node", key.alias("key"))
    lengths = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = postings.join(lengths, "key").groupBy("node")
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))
    # Lists of one class come first in the order of rarity and can't yield a pair.
    prefix = F.slice("lists", F.lit(1), F.size("lists") - F.lit(matches - 1))
    shared = shared.where(F.size("lists") >= matches)
    return shared.select("node", F.explode(prefix).alias("list")).select("list.key", "node")


def _may_link(percent: int) -> Column:
    """Whether sketches differ in no more bits than those of linked sets, but for five standard deviations."""
    share = (1 - percent / 100) / 2
    most = SKETCH_BITS * share + 5 * (SKETCH_BITS * share * (1 - share)) ** 0.5
    differing = [F.bit_count(F.get("sketch_a", i).bitwiseXOR(F.get("sketch_b", i))) for i in range(SKETCH_BITS // 64)]
    return sum(differing[1:], differing[0]) <= int(most)


def _between_components(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings with their component, in lists that hold more than one component."""
    placed = postings.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return placed.join(mixed.where("lo < hi").select("key"), "key", "left_semi")


def _leader_pairs(placed: DataFrame, round_number: int) -> DataFrame:
    """Each node with the leader that it meets in most lists, of those outside its component."""
    rank = F.xxhash64(F.lit(round_number), "node") if round_number else F.col("node")
    leaders = placed.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "component")).alias("leader"))
    leaders = leaders.select("key", F.col("leader.node").alias("b"), F.col("leader.component").alias("other"))
    met = placed.join(leaders, "key").where("component <> other").groupBy(F.col("node").alias("a"), "b").count()
    best = met.groupBy("a").agg(F.max(F.struct("count", (-F.col("b")).alias("b"))).alias("best"))
    return best.select("a", (-F.col("best.b")).alias("b"))


def _all_pairs_between(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that share a list, each from the first list that they share.

    Pairs whose sets differ too much in size, or whose sketches differ too much, never leave the join.
    """
    lists = placed.groupBy("node").agg(F.collect_set("key").alias("lists"))
    placed = placed.join(lists, "node").join(sets.select("node", "sketch", F.size("shingles").alias("n")), "node")
    columns = ("node", "component", "n", "sketch", "lists")
    left, right = (placed.select("key", *(F.col(name).alias(f"{name}_{side}") for name in columns)) for side in "ab")
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    first = F.col("key") == F.array_min(F.array_intersect("lists_a", "lists_b"))
    pairs = left.join(right, "key").where(apart & sizes & _may_link(percent) & first)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, coordinates: int = COORDINATES, matches: int = MATCHES, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents whose shingle sets have at least ``percent`` of their union in common are linked; ``component_id`` is the
    smallest doc_id that links reach, and only that document is kept. Texts that are null or have no words have empty
    sets and are linked with nothing. A null doc_id counts as the largest, and its component_id is null where nothing
    smaller is reached. Rows that repeat a doc_id are one document, linked by any of its texts; all of them are kept or
    none. Other columns are not read. A doc_id of
    text has to hold a whole number.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = scratch.stored(keyed.mapInArrow(
        lambda batches: sign(batches, size, coordinates),
        f"doc_id {id_type}, doc_key long, n_shingles long, set_a long, set_b long, signature array<int>",
    ), "signatures")
    same_set = ["set_a", "set_b", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_key").alias("node"))
    members = signed.join(classes.hint("merge"), same_set, "left").withColumn("node", F.coalesce("node", "doc_key"))
    members = scratch.stored(members.select("doc_id", "doc_key", "n_shingles", "node", F.when(
        (F.col("doc_key") == F.col("node")) & (F.col("n_shingles") > 0), F.col("signature")).alias("signature")), "members")

    postings = rarest_postings(members.where("signature IS NOT NULL"), coordinates, matches)
    postings = scratch.stored(postings.distinct(), "postings")
    wanted = postings.select("node").distinct()
    texts = keyed.select(F.col("doc_key").alias("node"), "text").join(wanted.hint("merge"), "node", "left_semi")
    sets = scratch.stored(texts.mapInArrow(
        lambda batches: full_sets(batches, size, coordinates), _SETS
    ), "sets")

    edges = _no_edges(docs)
    comps = scratch.stored(edges.selectExpr("u AS node", "v AS component"), "components")
    for round_number in range(LEADER_ROUNDS + 1):
        placed = scratch.stored(_between_components(postings, comps), "placed")
        if placed.isEmpty():
            break
        last = round_number == LEADER_ROUNDS
        pairs = _all_pairs_between(placed, sets, percent) if last else _leader_pairs(placed, round_number)
        found = confirmed(pairs, sets, matches, percent).selectExpr("a AS u", "b AS v")
        found = scratch.stored(found, "found")
        if not found.isEmpty():
            edges = scratch.stored(edges.union(found), "links")
            comps = scratch.stored(connected_components(edges, scratch), "components")

    joined = members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_key = joined.groupBy("doc_key").agg(F.min("component").alias("component"))
    result = joined.drop("component").join(by_key, "doc_key").select(
        "doc_id", "n_shingles",
        F.when(F.col("component") != _NO_ID, F.col("component")).cast(id_type).alias("component_id"),
        (F.col("doc_key") == F.col("component")).alias("kept"),
    )
    result = stored(result, "near")
    scratch.clear()
    return result


def _no_edges(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "u long, v long")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents of the smallest doc_id of each group of near duplicates, with the columns they had.

    Rows are matched by doc_id, null included; rows that repeat the doc_id of a kept document stay.
    """
    verdicts = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(verdicts["_kept_id"]), "left_semi")
