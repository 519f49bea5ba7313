"""Quality rules in DataFrame functions alone: counts of each text, and an n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. A document's score is the mean over its
n-grams of the log ratio of two multinomials over the buckets, the trusted target against the raw corpus; every document
with a mean below the threshold is rejected. What is known of either comes from labelled documents, so both are mixed with
the shares of all documents: the target is counted in trusted ones, the raw corpus in those with any label, which are a
sample of it. An n-gram without labels has the same share in both, and so a ratio of 1, however often it occurs; a language
or source with few labels is not rejected for that.

Texts are split once. Each document's counts and the buckets of its words are stored, and only these are joined with labels
and ratios, by sorting at every size. A pair's bucket is a hash of its words' buckets, so pairs need not be stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.llm.scratch import Scratch, stored

BUCKETS = 1 << 16
#: Part of the shares of all documents in either multinomial.
MIXED = 0.2
#: Rule: the first tenth below the scores of all labelled good documents of sf0.01 and sf0.1, each judged without its own
#: label (lowest -0.091). README has the figures for other tables.
THRESHOLD = -0.1
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
_BLANKS = "[ \\t-\\r]+"
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda word: word != "")


def _windows(words: Column, size: int) -> Column:
    """Hashes of each ``size`` consecutive words."""
    starts = F.sequence(F.lit(0), F.size(words) - F.lit(size))
    hashed = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def _bucket(hashed: Column) -> Column:
    """Bucket of a hash, less half their number, so that it is a 16-bit value."""
    return (F.pmod(hashed, F.lit(BUCKETS)) - F.lit(BUCKETS // 2)).cast("smallint")


def gram_buckets(words: Column) -> Column:
    """Buckets of the words and of each pair of neighbours, from the words' buckets."""
    starts = F.sequence(F.lit(0), F.size(words) - F.lit(2))
    pairs = F.transform(starts, lambda i: _bucket(F.xxhash64(F.get(words, i), F.get(words, i + 1))))
    return F.when(F.size(words) >= 2, F.concat(words, pairs)).otherwise(words)


def with_counts(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text_key, the five counts and the words' buckets of each whole text; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    key = F.monotonically_increasing_id().alias("row_key")
    first = docs.select(key, "doc_id", F.xxhash64("text").alias("text_key"), text.alias("text")).select(
        "row_key", "doc_id", "text_key", words_of(F.col("text")).alias("words"), with_word.alias("lines"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).alias("n_symbols"),
    )
    windows = first.withColumn("windows", _windows(F.col("words"), WINDOW))
    buckets = F.transform("words", lambda word: _bucket(F.xxhash64(word)))
    # Only texts in which a window repeats are sorted.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_windows = windows.withColumn("ordered", F.when(repeats, ordered))
    same = F.filter("ordered", lambda x, k: (x["h"] == F.get("ordered", k - 1)["h"]) | (x["h"] == F.get("ordered", k + 1)["h"]))
    starts = sorted_windows.withColumn("starts", F.sort_array(F.transform(same, lambda x: x["at"])))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", zero, lambda done, at: F.struct(
        (at + WINDOW).alias("reach"), (done["n"] + (at + WINDOW) - F.greatest(done["reach"], at)).alias("n")
    ), lambda done: done["n"])
    return starts.select(
        "row_key", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), buckets.alias("buckets"),
    )


def label_marks(labels: DataFrame) -> DataFrame:
    """doc_id of every document with a label, and trusted: 1 where some row says good and not toxic."""
    good = F.col("quality").eqNullSafe(1) & (F.coalesce("toxic", F.lit(0)) == 0)
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return named.groupBy("doc_id").agg(F.max(good.cast("int")).alias("trusted"))


def bucket_counts(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket and its n-grams in all documents (every), in labelled ones (raw) and in trusted ones (target).

    At most ``BUCKETS`` rows. All documents and all labels are counted, and counts are combined before the shuffle. Only
    rows with a doc_id meet the labels, so null ids do not meet in one task.
    """
    zero = F.lit(0).cast("long")
    every = counted.select(F.explode(gram_buckets(F.col("buckets"))).alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("every"), zero.alias("raw"), zero.alias("target"))
    marked = counted.select("doc_id", "buckets").join(label_marks(labels).hint("merge"), "doc_id")
    labelled = marked.select("trusted", F.explode(gram_buckets(F.col("buckets"))).alias("bucket")).groupBy("bucket").agg(
        zero.alias("every"), F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    names = ("every", "raw", "target")
    return every.union(labelled).groupBy("bucket").agg(*(F.sum(name).alias(name) for name in names))


def bucket_ratios(counts: DataFrame) -> DataFrame:
    """bucket and log ratio: the target's share against the raw corpus's, each mixed with the share in all documents."""
    every, raw, target = (n or 0 for n in counts.agg(F.sum("every"), F.sum("raw"), F.sum("target")).first())
    if not target:
        return counts.select("bucket", F.lit(0.0).alias("ratio"))

    def mixed(name: str, total: int) -> Column:
        return F.col(name) / total * (1 - MIXED) + F.col("every") / every * MIXED

    return counts.select("bucket", F.log(mixed("target", target) / mixed("raw", raw)).alias("ratio"))


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept and text_key.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed and a
    mean log ratio of at least ``threshold``. Null and empty texts have no words, so a null ratio, and fail. Rows are
    judged by their text, so repeated rows agree; without trusted documents every ratio is 0. Labels with a null quality
    or doc_id count for nothing. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.stored(with_counts(docs), "counted")
    ratios = F.broadcast(bucket_ratios(scratch.stored(bucket_counts(counted, labels), "buckets")))
    row = ["row_key", "doc_id", "text_key", *_BASE]
    scored = counted.select(*row, F.explode_outer(gram_buckets(F.col("buckets"))).alias("bucket")).join(ratios, "bucket", "left")
    scored = scored.groupBy(*row).agg(F.avg("ratio").alias("llr"))
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    failed = (F.col("n_words") < MIN_WORDS) | repeated
    judged = stored(scored.select(
        "doc_id", *_BASE, failed.alias("base_failed"), "llr",
        (~failed & (F.coalesce("llr", F.lit(0.0)) >= threshold)).alias("kept"), "text_key",
    ), "judged")
    scratch.clear()
    return judged


def keep_good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that ``judge_documents`` keeps, with the columns they had; matched by doc_id and text."""
    bad = judge_documents(docs, labels, threshold).where("NOT kept")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_text")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"])
    return docs.join(bad.hint("merge"), same, "left_anti")
