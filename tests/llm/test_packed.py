"""Packed numbers and words, and how the two indexes lie in their files."""

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from portage.llm import decontamination, lexical_search
from portage.llm import packed as P
from portage.llm.scratch import Scratch


@pytest.mark.parametrize("numbers", [[], [7], [0, -1, 255, 256, 2**31 - 1, -2**31], list(range(-3000, 3000))])
def test_numbers(numbers):
    packed = P.pack(np.array(numbers, np.int64))
    assert P.unpack(packed).tolist() == numbers
    assert P.unpack(pa.scalar(packed, pa.binary()).as_buffer()).tolist() == numbers


@pytest.mark.parametrize("words", [[], [b""], [b"", b"", b""], [b"a", b"", "naïve".encode(), b"\xff\x00" * 900, b"a"]])
def test_words(words):
    assert P.unpack_words(P.pack_words(pa.array(words, pa.binary()))).to_pylist() == words
    inside = pa.array([b"before", *words, b"after"], pa.binary()).slice(1, len(words))
    assert P.unpack_words(P.pack_words(inside)).to_pylist() == words


def test_words_of_strings():
    assert P.unpack_words(P.pack_words(pa.array(["字", "b"]))).to_pylist() == ["字".encode(), b"b"]


def files(table):
    return [pq.ParquetFile(unquote(urlparse(path).path)) for path in table.inputFiles()]


def long_texts(spark, n):
    words = np.random.default_rng(5).integers(0, 400, (n, 600_000))
    rows = [(i, " ".join(f"word{w}" for w in text)) for i, text in enumerate(words.tolist())]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_a_reader_holds_one_positional_segment_at_a_time(spark):
    [file] = files(decontamination.build_index(long_texts(spark, 3)))
    groups = [file.metadata.row_group(i) for i in range(file.metadata.num_row_groups)]
    assert len(groups) > 1 and all(group.num_rows == 1 for group in groups)
    row = file.read_row_group(0).to_batches()[0]
    assert row.nbytes < 600_000 * 4 / 2  # a position takes four bytes as a plain number


def test_a_reader_holds_one_segment_of_postings_at_a_time(spark):
    scratch = Scratch(spark)
    index, n_docs, n_terms = lexical_search.build_index(long_texts(spark, 3), scratch, 3 << 20)
    parts = [file for path in scratch.paths for file in files(spark.read.parquet(path))]
    groups = [file.metadata.row_group(i) for file in parts for i in range(file.metadata.num_row_groups)]
    assert (n_docs, n_terms, len(parts), len(groups)) == (3, 1_800_000, 2, 6) and all(group.num_rows == 1 for group in groups)
    assert index.schema["docs"].dataType == index.schema["terms"].dataType
    scratch.clear()


def test_postings_take_less_than_plain_numbers():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 20_000, 200)) for _ in range(2000)]
    batch = pa.record_batch({"doc_id": list(range(2000)), "text": texts})
    [plain] = lexical_search.count_segments(iter([batch]), 1 << 30)
    [stored] = lexical_search.packed_segments(iter([plain]))
    assert stored.nbytes < plain.nbytes / 2
    terms, counts = lexical_search.terms_of(stored, 0)
    assert terms.cast(pa.string()).to_pylist() == plain["terms"][0].as_py() and counts.tolist() == plain["counts"][0].as_py()
    docs, times = lexical_search.postings_of(stored, 0, "times")
    assert docs.astype("<i4").tobytes() == plain["docs"][0].as_py() and times.astype("<i4").tobytes() == plain["times"][0].as_py()
    held = pa.Table.from_batches(lexical_search.list_held_terms(iter([stored])))
    assert held["term"].to_pylist() == plain["terms"][0].as_py() and held["holders"].to_pylist() == plain["counts"][0].as_py()
