"""Operators on a small table of odd texts against plain Python, and on empty tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from portage.llm import (
    chat, decontamination, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup,
    warc,
)

_random = random.Random(5)
_words = ["the", "of", "Ärger", "x|y", "tion", "A", "b,", "naïve", "#1"] + [f"w{i}" for i in range(60)]


def _prose(n):
    return " ".join(_random.choice(_words) for _ in range(n))


PASSAGE, LONG = _prose(70), _prose(6000)
LINES = "\n".join(_prose(12) for _ in range(4))
TEXTS = [
    None, "", "   \n\t ", "one", "a b c", "a b c", PASSAGE, PASSAGE + " end", _prose(30) + " " + PASSAGE, LONG, LONG + " more",
    LINES, "first\n\n" + LINES + "\nlast", LINES.replace("\n", " \r\n"), _prose(25) + "\n" + _prose(9), "same same " * 40,
    "  leading and  double blanks here ", "tab\there\x0bthere", _prose(200),
]
DOCS = [(i, text) for i, text in enumerate(TEXTS)] + [(None, _prose(40)), (6, PASSAGE), (6, PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "en", 1, "clash", "clash") for i, text in DOCS]
    schema = "doc_id long, text string, lang string, n_removed int, covers string, node string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words(text):
    return (text or "").encode().split()


def key(doc_id):
    return -(2**63) if doc_id is None else doc_id


def collected(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)


def test_substring_dedup(docs, empty):
    first = {}
    for i, text in DOCS:
        w = words(text)
        for s in range(len(w) - 19):
            place = (key(i), s)
            first[tuple(w[s:s + 20])] = min(first.get(tuple(w[s:s + 20]), place), place)
    expected = []
    for i, text in DOCS:
        w = words(text)
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] < (key(i), s) for p in range(s, s + 20)}
        kept = b" ".join(word for p, word in enumerate(w) if p not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    result = substring_dedup.drop_repeated_passages(docs)
    assert collected(result, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)
    assert substring_dedup.drop_repeated_passages(empty).count() == 0


def test_a_common_phrase_does_not_fill_one_bucket(spark):
    """One phrase in every text, with ever different words beside it, whose grams have the smallest hashes."""
    draw, grams = random.Random(1), substring_dedup.W.window_hashes
    own = [f"x{i}" for i in range(4000)]
    candidates = [[draw.choice(own) for _ in range(4)] for _ in range(20000)]
    hashes = grams(substring_dedup.W.Words([" ".join(c).encode() for c in candidates]).hashes(), 4)[::4]
    phrase = candidates[int(np.argmin(hashes))]
    rows = [(i, i, " ".join(draw.choice(own) for _ in range(12)) + " " + " ".join(phrase) + " " + " ".join(draw.choice(own) for _ in range(12)))
            for i in range(1500)]
    docs = spark.createDataFrame([(i, text) for i, _, text in rows], "doc_id long, text string")
    common = substring_dedup.common_grams(docs)
    assert 1 <= len(common) <= 4096
    batch = substring_dedup.pa.record_batch({"doc_key": [r[0] for r in rows], "text_key": [r[1] for r in rows], "text": [r[2] for r in rows]})

    def largest(common):
        (packed,) = substring_dedup.pack_super_kmers(iter([batch]), 20, 4, 64, common)
        sizes = {}
        for bucket, data in zip(packed["bucket"].to_pylist(), packed["packed"].to_pylist()):
            sizes[bucket] = sizes.get(bucket, 0) + len(substring_dedup._unpack(data, 4)[1])
        return max(sizes.values()) / sum(sizes.values())

    assert largest(np.zeros(0, np.uint64)) > 0.8 and largest(common) < 0.1
    result = substring_dedup.drop_repeated_passages(docs.union(docs.where("doc_id = 7").selectExpr("9999", "text")))
    assert [r.doc_id for r in result.where("n_removed > 0").collect()] == [9999]


def test_equal_hashes_of_different_windows_are_settled_by_words():
    w = substring_dedup.W.Words([b"a b c", b"a b d", b"a b c"])
    flags, unsettled = substring_dedup._with_earlier_copy(w, np.array([0, 3, 6]), np.arange(3), np.zeros(3, np.uint64), 3)
    assert flags.tolist() == [False, False, True] and unsettled.tolist() == [1]


def _shingles(text):
    w = [word.translate(substring_dedup.W.LOWER) for word in words(text)]
    return {tuple(w[s:s + 5]) for s in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(docs, empty):
    largest = 2**63 - 1
    sets = [(largest if i is None else i, _shingles(text)) for i, text in DOCS]
    component = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    expected = []
    for (i, _), (k, s) in zip(DOCS, sets):
        expected.append((i, len(s), None if component[k] == largest else component[k], component[k] == k))
    result = near_dedup.near_duplicates(docs)
    assert collected(result, "doc_id", "n_shingles", "component_id", "kept") == sorted(expected, key=repr)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one_of_each_group(docs).columns == docs.columns


def test_line_dedup(docs, empty):
    def solid(text):
        return [tuple(line.split()) for line in (text or "").encode().split(b"\n") if line.split()]

    first, expected = {}, []
    for i, text in DOCS:
        lines = solid(text)
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(map(len, lines[s:e])) >= 20:
                    run = tuple(lines[s:e])
                    first[run] = min(first.get(run, (key(i), s)), (key(i), s))
    for i, text in DOCS:
        lines = solid(text)
        gone = {p for s in range(len(lines)) for e in range(s + 1, len(lines) + 1)
                if first.get(tuple(lines[s:e]), (key(i), s)) < (key(i), s) for p in range(s, e)}
        expected.append((i, len(lines), len(gone)))
    result = line_dedup.drop_repeated_lines(docs)
    assert collected(result, "doc_id", "n_lines", "n_removed") == sorted(expected, key=repr)
    kept = line_dedup.keep_first_copies_of_lines(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (11, 13)").count() == 1
    assert kept.where("doc_id = 12").first().text == "first\n\nlast"
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def _alnum(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().translate(substring_dedup.W.LOWER))


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(PASSAGE.split()[5:30])), (2, "A, b! C"), (3, None), (4, "..."), (10, "A, b! C"), (5, _prose(15))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, text in DOCS:
        w, hit, held = _alnum(text), set(), set()
        for item, item_text in items:
            v = _alnum(item_text)
            for s in range(max(len(v) - 10, 0) + 1 if v else 0):
                window = v[s:s + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p:p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        held.add(str(item))
        expected.append((i, len(w), len(hit), sorted(held), bool(hit)))
    result = decontamination.contaminated_documents(docs, benchmark)
    assert collected(result, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(expected, key=repr)
    assert decontamination.contaminated_documents(empty, benchmark).count() == 0
    assert decontamination.contaminated_documents(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.drop_contaminated(docs, benchmark).columns == docs.columns


def test_blocks_of_test_items_give_the_same_matches(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(i, " ".join(LONG.split()[i * 50:i * 50 + 12])) for i in range(20)], "item_id long, text string")
    whole = collected(decontamination.contaminated_documents(docs, benchmark), "doc_id", "n_hit", "items")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert collected(decontamination.contaminated_documents(docs, benchmark), "doc_id", "n_hit", "items") == whole


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x one two filler three y"), (2, "three z one q q q q q q two")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    found = decontamination.benchmark_matches(decontamination.build_index(docs), benchmark, slop=1)
    assert {row.doc_id: [(s.start, s.end) for s in row.spans] for row in found.collect()} == {1: [(1, 5)], 2: []}


def test_items_near_a_document(spark, docs, empty):
    items = [(1, "alpha beta"), (2, " ".join(PASSAGE.split()[5:30])), (3, None), (4, "..."), (5, "b a c a"), (5, "alpha beta"),
             (6, " ".join(reversed(PASSAGE.split()[5:15])))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [(901, "beta x y alpha"), (902, "beta x y z alpha"), (903, "c d b a"), (903, "c d b a"), (904, None), (905, "alpha beta")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    expected = []
    for i, text in DOCS + texts:
        w, held = _alnum(text), set()
        for item, item_text in items:
            v = _alnum(item_text)
            for s in range(max(len(v) - 10, 0) + 1 if v else 0):
                window = v[s:s + 10]
                for p in range(len(w)):
                    if set(window) <= set(w[p:p + len(window) + 2]):
                        held.add(str(item))
        expected.append((i, sorted(held)))
    found = decontamination.contaminated_documents(table, benchmark, slop=2)
    assert collected(found, "doc_id", "near_items") == sorted(expected, key=repr)
    exact = decontamination.contaminated_documents(table, benchmark)
    columns = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    assert collected(found, *columns) == collected(exact, *columns)
    assert exact.where("size(near) + size(near_items) > 0").count() == 0
    assert decontamination.contaminated_documents(empty, benchmark, slop=2).count() == 0


def test_sharding(docs, empty):
    sixteen, seventeen = dict.fromkeys(range(16), 1.0), dict.fromkeys(range(17), 1.0)
    rows = sharding.assign_shards(docs, sixteen, seventeen).collect()
    assert len(rows) == len(DOCS)
    for shard in {row.shard for row in rows}:
        assert sorted(row.slot for row in rows if row.shard == shard) == list(range(sum(row.shard == shard for row in rows)))
    texts = {(i, zlib.crc32((text or "").encode()), len((text or "").encode()) + 1) for i, text in DOCS}
    assert {(row.doc_id, row.text_crc32, row.size) for row in rows} == texts
    assert all(row.grown_shard in (row.shard, 16) for row in rows)
    assert sharding.assign_shards(empty, sixteen).count() == 0


def test_weights_set_the_shares(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "CAST(doc_id AS STRING) AS text")
    counts = {row.shard: row["count"] for row in sharding.assign_shards(ids, {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()}
    assert abs(counts[1] / 20000 - 0.75) < 0.02


def test_texts_that_differ_in_every_letter_are_not_linked(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one + " " + two), (4, two + " " + one)], "doc_id long, text string")
    assert {row.doc_id: row.component_id for row in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = packing.pack_documents(docs, path, pattern, with_ids=True, added=ADDED).collect()
    expected = sorted(tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]) for _, text in DOCS)
    pieces, sequences = {}, {}
    for row in rows:
        ids = np.frombuffer(bytes(row.ids), "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) == (row.length, row.ids_crc32)
        if row.doc_id != 6:
            pieces.setdefault(row.doc_id, []).append((row.start, ids))
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    whole = sorted(tuple(np.concatenate([ids for _, ids in sorted(p, key=lambda x: x[0])]).tolist()) for p in pieces.values())
    repeated = tuple([*tokenizer.encode(PASSAGE, add_special_tokens=False).ids, 1])
    assert whole == sorted(ids for ids in expected if ids != repeated) and expected.count(repeated) == 3
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(empty, path, pattern).count() == 0


ADDED = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_of_texts_with_added_tokens():
    assert ADDED == {"<|endoftext|>": 50256}
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "<|endoftext|", "no such token", "  <|endoftext|>\n"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ADDED)
    ids = own.ids(packing.pa.array(texts))
    assert [i.tolist() for i in ids] == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_sum_of_squares_rule():
    rng = random.Random(3)
    lengths = [rng.randint(1, 20) for _ in range(400)]
    levels = {}
    for size, (sequence, offset) in zip(lengths, packing.place_by_squares(lengths, 20)):
        count = np.bincount([level for level in levels.values() if level < 20], minlength=21)

        def squares(level):
            after = count.copy()
            after[level] -= level > 0
            after[level + size] += 1
            return int((after[1:20] ** 2).sum())

        assert levels.get(sequence, 0) == offset
        choices = [h for h in range(0, 21 - size) if h == 0 or count[h]]
        assert squares(offset) == min(map(squares, choices))
        levels[sequence] = offset + size


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ü" * 800
    pages = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "d", "small"), (5, "e", "small"),
             (None, "f", big), (2, "http://b\r\nX: y", big)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archive(table, str(tmp_path / "archive"))
    records = collected(warc.read_page_records(spark, str(tmp_path / "archive")), "page_id", "payload_bytes", "record_type", "refers_to")
    size = len(big.encode())
    assert records == sorted([
        (1, size, "revisit", 2), (2, size, "response", None), (2, size, "response", None), (3, 0, "response", None),
        (4, 5, "response", None), (5, 5, "response", None), (None, size, "revisit", 2)], key=repr)
    assert spark.read.parquet(str(tmp_path / "archive/payloads")).count() == 3
    for row in warc.read_archive(spark, str(tmp_path / "archive")).collect():
        header, block = bytes(row.record).split(b"\r\n\r\n", 1)
        assert int(re.search(rb"\r\nContent-Length: (\d+)$", header)[1]) == len(block) - 4
        if b"WARC-Type: response" in header:
            assert block[:-4].split(b"\r\n\r\n", 1)[1] == bytes(row.payload)
    warc.write_archive(table.limit(0), str(tmp_path / "empty"))
    assert warc.read_page_records(spark, str(tmp_path / "empty")).count() == 0


def test_warc_keeps_every_url_of_a_page(spark, tmp_path):
    html = "<p>same</p>" * 200
    rows = [(1, "http://a/1", html), (1, "http://a/2", html), (1, "http://a/2", html), (0, "http://b/", html), (1, None, html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "urls"))
    found = warc.read_archive(spark, str(tmp_path / "urls")).select(warc.header_field("WARC-Target-URI").alias("url")).collect()
    assert sorted((row.url or "" for row in found)) == sorted(url or "" for _, url, _ in rows)
    assert spark.read.parquet(str(tmp_path / "urls/payloads")).count() == 1


def test_a_changed_payload_is_noticed(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("sha256", "CAST('other' AS BINARY) AS payload")
    stored.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read_page_records(spark, str(tmp_path / "b")).collect()


ODD_TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|end|>\n", "\\u41;", "\\u", "<|start|>user<|text|>x<|end|>\n", "<<s>>", "a<|en",
             "<s<s>>", "\\u5c;u41;", "ends with <", "<|text|><|text|>"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_turns_parse_to_themselves(text):
    formatted = chat.render_turn(text, text)
    assert [turn[:2] for turn in chat.parse(formatted)] == [(text, text)]
    assert [turn[:2] for turn in chat.parse(formatted + chat.render_turn("user", text))] == [(text, text), ("user", text)]


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", "é" * 9), (2, 0, "assistant", "é" * 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    result = {row.conv_id: row for row in chat.read_conversations(chat.format_conversations(table)).collect()}
    assert result[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert (result[2].n_turns, result[2].loss_chars) == (3, 18)
    assert result[2].loss_sha256 == hashlib.sha256(("é" * 18).encode()).hexdigest()
    assert chat.read_conversations(chat.format_conversations(table.limit(0))).count() == 0


def _xx(*values):
    seed = 42
    for value in values:
        seed = xxhash.xxh64_intdigest(value, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def _ratios(docs, trusted, labelled):
    """Mean log ratio of each text, by plain Python: trusted against labelled documents, both mixed with all of them."""
    grams, counts = [], {"every": {}, "raw": {}, "target": {}}
    for i, text in docs:
        w = words(text)
        own = [_xx(a) % 2**16 - 2**15 for a in w]
        pairs = [_xx(struct.pack("<i", a), struct.pack("<i", b)) % 2**16 - 2**15 for a, b in zip(own, own[1:])]
        grams.append(own + pairs)
        for name, counted in (("every", True), ("raw", i in labelled), ("target", i in trusted)):
            for gram in grams[-1] if counted else ():
                counts[name][gram] = counts[name].get(gram, 0) + 1

    def share(name, gram):
        own = counts[name].get(gram, 0) / sum(counts[name].values())
        return 0.8 * own + 0.2 * counts["every"][gram] / sum(counts["every"].values())

    if not counts["target"]:
        return [0.0 if own else None for own in grams]
    ratio = {gram: np.log(share("target", gram) / share("raw", gram)) for gram in counts["every"]}
    return [np.mean([ratio[g] for g in own]) if own else None for own in grams]


def test_quality_rules(spark, docs, empty):
    rows = [(6, 1, 0), (8, 1, 0), (9, 1, None), (11, 0, 0), (15, 0, 0), (18, 1, 1), (10, None, 0), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    expected = []
    for (i, text), llr in zip(DOCS, _ratios(DOCS, {6, 8, 9}, {6, 8, 9, 11, 15, 18})):
        w, lines, covered = words(text), [line for line in (text or "").split("\n") if line.encode().split()], set()
        windows = [tuple(w[s:s + 5]) for s in range(len(w) - 4)]
        for s, window in enumerate(windows):
            if windows.count(window) > 1:
                covered |= set(range(s, s + 5))
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        kept = bool(not failed and (llr or 0) >= quality_rules.THRESHOLD)
        expected.append((i, len(w), len(b"".join(w).decode()), len(re.findall(r"[#*$%&|<>]", text or "")),
                         len(lines) - len(set(lines)), len(covered), failed, kept, None if llr is None else round(float(llr), 9)))
    result = quality_rules.judge_documents(docs, labels).withColumn("llr", F.round("llr", 9))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    assert collected(result, *names) == sorted(expected, key=repr)
    assert {6, 8, 9} <= {row.doc_id for row in result.where("kept").collect()}
    assert quality_rules.judge_documents(empty, labels).count() == 0
    unlabelled = quality_rules.judge_documents(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(DOCS) and {row.llr for row in unlabelled} == {None, 0.0}
    assert quality_rules.keep_good_documents(docs, labels).columns == docs.columns


def test_all_labelled_documents_are_counted(spark):
    n = 20_001
    rows = spark.range(n).selectExpr("id AS doc_id", "'one two' AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    counts = quality_rules.bucket_counts(quality_rules.with_counts(rows), labels).collect()
    assert sorted((row.every, row.raw, row.target) for row in counts) == [(n, n, n // 2)] * 3


def test_a_language_with_few_labels_is_kept(spark):
    draw = random.Random(3)
    tongues = {lang: [f"{lang}{i}" for i in range(200)] for lang in ("en", "de", "fr")}
    rows, labels, clean = [], [], set()
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        text = [draw.choice(tongues[lang]) for _ in range(60)]
        if bad := i % 8 == 0:
            text = [word + "&&&" for word in text]
        else:
            clean.add(i)
        rows.append((i, " ".join(text)))
        # one good German label, no good French one
        if bad or lang == "en" or i == 1:
            labels.append((i, int(not bad), 0))
    result = quality_rules.keep_good_documents(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {row.doc_id for row in result.collect()} == clean


def test_classifier_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    scored = quality_classifier.score_documents(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id")
    rows = scored.where("held_out").collect()
    assert all(0 <= row.score <= 1 for row in rows) and all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in rows)
    assert np.mean([row.predicted == row.quality for row in rows]) >= 0.95


def test_classifier_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1), (6, 0), (9, None), (15, 0), (16, 0), (18, 1), (99, 1)], "doc_id long, quality int")
    assert quality_classifier.score_documents(docs, labels).where("score BETWEEN 0 AND 1").count() == len(DOCS)
    assert {row.score for row in quality_classifier.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_documents(empty, labels).count() == 0


def test_isotonic_pools_violators():
    assert quality_classifier.isotonic(np.array([0.0, 1, 0, 2]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 2.0]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and 0 < docs.count() <= seen
        seen = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == seen
