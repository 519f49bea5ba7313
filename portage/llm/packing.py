"""Packing of documents into sequences of fixed length by the sum-of-squares rule.

Documents are cut at every ``capacity`` tokens, so each has full pieces and at most one shorter piece. Full pieces fill
sequences of their own. The others are packed online: with N(h) partly filled sequences at level h, a piece goes where
the sum of N(h)^2 becomes smallest. Documents are dealt to groups of bounded expected size, each packed by one task with
one level array; at most ``capacity`` levels of a group stay open.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portage.llm import words as W
from portage.llm.scratch import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 1
#: Expected documents of a group. More groups leave more partly filled sequences.
GROUP_DOCUMENTS = 50_000


class WordTokenizer:
    """Ids of texts by byte-level BPE, each distinct word of a chunk encoded once.

    The vocabulary file lists the merged byte strings in the order of their ids; ``added`` are whole strings with ids of
    their own, at which texts are split first. So the ids are those of the ``tokenizers`` file with the same vocabulary.
    Where all blanks are single spaces and line ends between words, the pattern never joins characters across them, so a
    word with the blank before it is encoded on its own. Other texts, and those with an added string, are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self._added, self._encode = set(added), encoding.encode_ordinary
        self._encode_whole = lambda text: encoding.encode(text, allowed_special=self._added)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = _plain(texts)
        for added in self._added:
            plain = pc.and_not(plain, pc.match_substring(texts, added))
        words = pc.split_pattern(pc.replace_substring(texts.filter(plain), "\n", " \n"), pattern=" ")
        encoded = iter(self._word_ids(words))
        return [
            next(encoded) if p else np.array(self._encode_whole(text), np.uint32)
            for p, text in zip(plain.to_pylist(), texts.to_pylist())
        ]

    def _word_ids(self, words: pa.ListArray) -> list[np.ndarray]:
        flat = words.flatten().dictionary_encode()
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        number = flat.indices.to_numpy()
        distinct = flat.dictionary.to_pylist()
        # The first word of a text has no blank before it; all others but line starts have a space.
        n, first = len(distinct), np.zeros(len(number), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        opening = np.unique(number[first])
        keys = [w if w.startswith("\n") else " " + w for w in distinct] + [distinct[i] for i in opening.tolist()]
        number = np.where(first, n + np.searchsorted(opening, number), number)
        encoded = [self._encode(key) for key in keys]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        pool = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(sizes.sum()))
        heads = np.cumsum(sizes) - sizes
        lengths = sizes[number]
        ends = np.cumsum(lengths)
        gather = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(heads[number] - (ends - lengths), lengths)
        ids = pool[gather]
        cuts = np.concatenate(([0], ends))[offsets]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Strings that a ``tokenizers`` file matches before its pattern, with their ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(token[option] for token in tokens for option in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{tokenizer_path} has added tokens that match by more than their text")
    return {token["content"]: token["id"] for token in tokens}


def _plain(texts: pa.Array) -> pa.Array:
    """Texts whose only blanks are single spaces and line ends between other characters; empty ones are not."""
    other = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    odd = pc.match_substring_regex(texts, rf"^[ \n]|[ \n]$|[ \n][ \n]|{other}|^$")
    return pc.invert(odd)


def cut_pieces(
    batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, added: dict[str, int], capacity: int, end_id: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    """Pieces of each document: its ids and ``end_id``, cut at every ``capacity`` ids."""
    tokenizer = WordTokenizer(ranks_path, pattern, added)
    for part, _ in W.chunks(batches):
        rows = []
        for doc, text_key, ids in zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(),
                                      tokenizer.ids(part.column("text"))):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), capacity):
                piece = ids[start:start + capacity]
                data = piece.tobytes()
                rows.append((doc, text_key, start, len(piece), zlib.crc32(data), len(ids), data if with_ids else None))
        names = ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        kinds = [part.schema.field("doc_id").type, *[pa.int64()] * 5, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def place_by_squares(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece in turn; ties go to the fullest level, and of one level to the newest sequence."""
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, used = [], 0
    for size in lengths:
        level = 0
        if size < capacity:
            # Moving a sequence from level h to h + size changes the sum of squares by 2 (N(h + size) - N(h) + 1);
            # a full sequence no longer counts, and a new one only adds 2 N(size) + 1.
            room = capacity - size
            gain = 2 * (count[size + 1:capacity + 1] - count[1:room + 1] + 1)
            gain[-1] = 1 - 2 * count[room]
            gain[count[1:room + 1] == 0] = np.iinfo(np.int64).max
            best = room - int(np.argmin(gain[::-1]))
            if gain[best - 1] <= 2 * count[size] + 1:
                level = best
        if level:
            sequence = open_at[level].pop()
            count[level] -= 1
        else:
            sequence, used = used, used + 1
        placed.append((sequence, level))
        if level + size < capacity:
            open_at[level + size].append(sequence)
            count[level + size] += 1
    return placed


def pack_group(pieces: pa.Table, capacity: int) -> pa.Table:
    """sequence_id and offset for the pieces of one group, taken in the order of doc_id and start."""
    pieces = pieces.sort_by([(name, "ascending") for name in ("doc_id", "text_key", "start", "ids_crc32")])
    placed = place_by_squares(pieces.column("length").to_pylist(), capacity)
    base = (pieces.column("group")[0].as_py() if pieces.num_rows else 0) << 32
    pieces = pieces.append_column("sequence_id", pa.array([base + s for s, _ in placed], pa.int64()))
    return pieces.append_column("offset", pa.array([o for _, o in placed], pa.int64())).drop_columns(["group", "text_key"])


def pack_documents(
    docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID,
    group_documents: int = GROUP_DOCUMENTS, with_ids: bool = False, added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (if asked for), sequence_id and offset.

    Each id of each document lies in one piece, and a sequence holds at most ``capacity`` ids; what is missing is
    padding. ``added`` gives strings that are one token each, wherever they stand in a text. A null or empty text is the end id alone. Null doc_ids and repeated rows are packed like any other. The
    vocabulary file must exist at ``ranks_path`` on the executors. Other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = "start long, length long, ids_crc32 long, doc_tokens long"
    pieces = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        lambda batches: cut_pieces(batches, ranks_path, pattern, added or {}, capacity, end_id, with_ids),
        f"doc_id {id_type}, text_key long, {columns}, ids binary",
    )
    pieces = stored(pieces.withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    groups = -(-pieces.where("start = 0").count() // group_documents) or 1
    # Ids stay behind: a group is packed by lengths alone.
    small = pieces.drop("ids").withColumn("group", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(groups)))
    packed = small.groupBy("group").applyInArrow(
        lambda table: pack_group(table, capacity), f"doc_id {id_type}, {columns}, piece_key long, sequence_id long, offset long",
    )
    if with_ids:
        packed = packed.join(pieces.select("piece_key", "ids").hint("merge"), "piece_key")
    return packed.drop("piece_key")
