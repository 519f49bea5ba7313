"""Operators that SQL can't express, and the whole pipeline, against plain versions written from their definitions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
from test_operators import _alnum, _ratios, _shingles
from tokenizers import Tokenizer

from portage.llm import packing, quality_classifier, quality_rules, sharding

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# Sharding ------------------------------------------------------------------------------------------------------------


def bid(key, shard, weight):
    point = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 1) / 16**13
    return -math.log(point) / weight, shard


def shard_of(doc_id, weights):
    key = "" if doc_id is None else str(doc_id)
    return min(bid(key, shard, weight) for shard, weight in weights.items())[1]


def test_every_row_is_in_the_shard_and_slot_of_its_key(spark):
    rows = [(i, f"text {i % 7}" * (i % 3)) for i in range(-50, 3000)] + [(None, "x"), (None, None), (5, "again"), (5, "text 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for weights in (dict.fromkeys(range(16), 1.0), {0: 1.0, 3: 2.5, 7: 0.25}, {4: 1.0}):
        grown = {**weights, 99: 1.0}
        expected, slots = [], {}
        for i, text in rows:
            data, key = (text or "").encode(), "" if i is None else str(i)
            shard = shard_of(i, weights)
            bucket = int(hashlib.md5(key.encode()).hexdigest()[:3], 16)
            slots.setdefault(shard, []).append((bucket, i is not None, i or 0, zlib.crc32(data), len(data) + 1))
            expected.append((i, len(data) + 1, zlib.crc32(data), "key", shard, shard_of(i, grown)))
        found = sharding.assign_shards(docs, weights, grown).collect()
        assert sorted(((*row[:5], row.grown_shard) for row in found), key=repr) == sorted(expected, key=repr)
        for shard, places in slots.items():
            own = sorted((row for row in found if row.shard == shard), key=lambda row: row.slot)
            assert [(row.doc_id, row.text_crc32, row["size"]) for row in own] == [
                (i if known else None, crc, size) for _, known, i, crc, size in sorted(places)]


# Classifier ----------------------------------------------------------------------------------------------------------


def statistics(text):
    """The statistics of one text, one by one."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(quality_classifier.STATISTICS)

    def share(characters):
        return sum(c in characters.encode() for c in data) / len(data)

    shares = [data.count(bytes([c])) / len(data) for c in set(data)]
    row = [math.log(1 + len(data)), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("abcdefghijklmnopqrstuvwxyz"), share("0123456789"),
           share(" \t\r\v\f"), share("\n"), share(".,;:?"), share("\"'()[]{}/\\-_=+~^`@"), share("#*$%&<>"), share("|"), share("!"),
           sum(c > 127 for c in data) / len(data), -sum(p * math.log2(p) for p in shares)]
    words = data.split()
    row.append(math.log(1 + len(words)))
    if not words:
        return row + [0.0] * 9
    sizes, lines = [len(w) for w in words], [line for line in data.split(b"\n") if line.strip()]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    mean = sum(sizes) / len(sizes)
    return row + [
        mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)), sum(s <= 3 for s in sizes) / len(sizes),
        sum(s >= 15 for s in sizes) / len(sizes), len(set(words)) / len(words), max(map(words.count, words)) / len(words),
        math.log(1 + len(words) / len(lines)), 1 - len(set(lines)) / len(lines),
        1 - len(set(windows)) / len(windows) if windows else 0.0]


def isotonic(values, weights):
    """The fit at i is the largest over starts up to i of the smallest over ends from i of the means between."""
    n = len(values)

    def mean(a, b):
        return sum(v * w for v, w in zip(values[a:b + 1], weights[a:b + 1])) / sum(weights[a:b + 1])

    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_model_is_that_of_a_plain_ridge_fit(spark, sf_dir):
    draw = random.Random(2)
    vocabulary = ["the", "A", "naïve", "#", "|", "w1", "longlonglonglong", "x!", "\n", "\n\n"]
    texts = [None, "", " \n "] + [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 40))) for _ in range(200)]
    stats = quality_classifier.statistics_of([None if t is None else t.encode() for t in texts])
    assert np.allclose(stats, [statistics(t) for t in texts], atol=1e-12)

    y = np.array([float((t or "").count("#") > 1) for t in texts])
    rows = spark.createDataFrame([(s.tolist(), q) for s, q in zip(stats, y.tolist())], "stats array<double>, quality double").repartition(4)
    model = quality_classifier.fit(rows, features=16)
    x = np.clip((stats - stats.mean(axis=0)) / np.where(stats.std(axis=0) > 1e-9, stats.std(axis=0), 1.0), -4, 4)
    random_numbers = np.random.default_rng(7)
    directions = random_numbers.normal(size=(stats.shape[1], 16)) / np.sqrt(stats.shape[1])
    z = np.column_stack([np.sqrt(2 / 16) * np.cos(x @ directions + random_numbers.uniform(0, 2 * np.pi, 16)), np.ones(len(x))])
    ridge = 1e-3 * len(y) / 16 * np.eye(17)
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-8)

    # Leave one out: a fit without the row (and the same ridge), in steps, then the calibration.
    raw = []
    for i in range(len(y)):
        rest = np.delete(z, i, axis=0)
        raw.append(z[i] @ np.linalg.solve(rest.T @ rest + ridge, rest.T @ np.delete(y, i)))
    steps = np.round(np.clip(raw, -1, 2) / quality_classifier.STEP).astype(int)
    distinct = sorted(set(steps.tolist()))
    counts, goods = ([float(f(steps == s)) for s in distinct] for f in (np.sum, lambda own: y[own].sum()))
    fitted = np.round(isotonic([g / n for g, n in zip(goods, counts)], counts), 12)
    curve = []
    for value in sorted(set(fitted.tolist())):
        own = [k for k, v in enumerate(fitted) if v == value]
        n = sum(counts[k] for k in own)
        middle = sum(distinct[k] * counts[k] for k in own) / n * quality_classifier.STEP
        curve.append((middle, (sum(goods[k] for k in own) + y.mean()) / (n + 1)))
    assert np.allclose(model.curve_x, [c[0] for c in curve], atol=2 * quality_classifier.STEP)
    assert np.allclose(model.curve_y, np.maximum.accumulate([c[1] for c in curve]), atol=1e-6)
    calibrated = np.interp(z @ model.weights, model.curve_x, model.curve_y)
    expected = 0.999 * calibrated + 0.001 * np.clip((z @ model.weights + 1) / 3, 0, 1)
    assert np.allclose(model.score(stats), expected, atol=1e-9)


# Pipeline ------------------------------------------------------------------------------------------------------------


def plain_pipeline(docs, labels, items):
    """doc_id to the ids of each document that is left, by plain Python."""
    trusted = {i for i, quality, toxic in labels if quality == 1 and not toxic}
    labelled = {i for i, quality, _ in labels if quality is not None}
    kept = {}
    for (i, text), llr in zip(docs, _ratios(docs, trusted, labelled)):
        words = text.encode().split()
        windows = [tuple(words[s:s + 5]) for s in range(len(words) - 4)]
        covered = {p for s, w in enumerate(windows) if windows.count(w) > 1 for p in range(s, s + 5)}
        if len(words) >= 10 and 100 * len(covered) <= 20 * len(words) and llr >= quality_rules.THRESHOLD:
            kept[i] = text
    # Runs of lines with 20 words or more that stand further ahead go.
    solid = {i: [tuple(line.split()) for line in text.encode().split(b"\n") if line.split()] for i, text in kept.items()}
    first = {}
    for i, lines in solid.items():
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(map(len, lines[s:e])) >= 20:
                    first[tuple(lines[s:e])] = min(first.get(tuple(lines[s:e]), (i, s)), (i, s))
    for i, lines in solid.items():
        gone = {p for s in range(len(lines)) for e in range(s + 1, len(lines) + 1)
                if first.get(tuple(lines[s:e]), (i, s)) < (i, s) for p in range(s, e)}
        if gone:
            places = iter(range(len(lines)))
            left = [line for line in kept[i].split("\n") if not (line.split() and next(places) in gone)]
            kept[i] = None if len(gone) == len(lines) else "\n".join(left)
    kept = {i: text for i, text in kept.items() if text is not None}
    sets = {i: _shingles(text) for i, text in kept.items()}
    component = {i: i for i in sets}
    for _ in range(6):
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    kept = {i: text for i, text in kept.items() if component[i] == i}
    windows = set()
    for _, text in items:
        words = _alnum(text)
        windows |= {tuple(words[s:s + 10]) for s in range(max(len(words) - 9, 1))} if words else set()
    out = {}
    for i, text in kept.items():
        words = _alnum(text)
        if not any(tuple(words[p:p + n]) in windows for n in range(1, 11) for p in range(len(words) - n + 1)):
            out[i] = [*TOKENIZER.encode(text, add_special_tokens=False).ids, packing.END_ID]
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(9)
    clean, junk = [f"word{i}" for i in range(300)], [f"junk{i}!!" for i in range(30)]

    def prose(n, vocabulary=clean):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    def lined(n):
        return "\n".join(prose(9) for _ in range(n))

    docs = [(i, lined(draw.randrange(2, 8))) for i in range(60)]
    docs += [(100 + i, prose(60, junk)) for i in range(12)]  # some are labelled bad
    run, passage = lined(3), prose(14)
    docs += [(200 + i, lined(2) + "\n" + run + "\n" + lined(2)) for i in range(4)] + [(210, run)]
    near = prose(120).split()
    docs += [(220 + i, " ".join(near[:60 + i] + [f"changed{i}"] + near[61 + i:])) for i in range(5)] + [(230, " ".join(near))] * 1
    docs += [(240, prose(30) + " " + passage + " " + prose(30)), (241, "Short benchmark item here, and " + prose(20)), (242, prose(5000))]
    docs += [(250, "a <|endoftext|> token in " + prose(20)), (251, prose(9)), (252, "same five words said again " * 8), (253, "")]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(6)] + [(1, 1, 1), (3, None, 0)]
    items = [(1, passage), (2, "short benchmark, ITEM!"), (3, None), (4, "nowhere at all to be found")]
    folder = tmp_path / "data"
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    for name, table in tables.items():
        table.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    expected = plain_pipeline(docs, labels, items)
    gone = {i for i, _ in docs} - set(expected)
    assert {100, 106, 111, 210, 221, 224, 240, 241, 251, 252, 253} <= gone and len(expected) > 50
    pieces, sequences = {}, {}
    for row in corpus_pipeline.run(spark, str(folder)).collect():
        ids = np.frombuffer(bytes(row.ids), "<u4").tolist()
        assert len(ids) == row.length and zlib.crc32(bytes(row.ids)) == row.ids_crc32
        pieces.setdefault(row.doc_id, []).append((row.start, ids))
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    assert {i: [n for _, ids in sorted(p) for n in ids] for i, p in pieces.items()} == expected
    for placed in sequences.values():
        ends = [0] + [offset + length for offset, length in sorted(placed)]
        assert [offset for offset, _ in sorted(placed)] == ends[:-1] and ends[-1] <= packing.CAPACITY
