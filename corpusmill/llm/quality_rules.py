"""Quality rules: fixed text rules, then a hashed n-gram log-likelihood ratio.

Native: DataFrame functions only. Two narrow scans; only bucket counts (at most `buckets` rows a task)
are shuffled, and only the model (`buckets` numbers, a parameter) reaches the driver.

Every text's words and word pairs are hashed to buckets. Two smoothed multinomials over the buckets are
counted over all documents: the raw corpus, and the trusted target (documents labelled as good).
A text's score is the sum of log(target/raw) over its n-grams, divided by their number; the text is
kept when no base rule fails and the score reaches a fixed threshold.

Cases: null and empty texts have no words, fail the base rules and score 0. A document without a label,
or with a null one, counts in the raw multinomial only; repeated labels count once. Texts are read whole;
repeated rows are judged alike, row by row. Without any trusted document all scores are 0. Extra columns
are not passed on. Empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import doubles, let, space_words, whole

SYMBOLS = "#*$%&|<>"
BUCKETS = 16384
#: Mean log ratio (nats an n-gram) that a text must reach: slightly less target-like than the corpus is still kept.
THRESHOLD = -0.06
#: Up to so many trusted ids are broadcast (8 bytes each); beyond, documents and ids meet in a merge join.
BROADCAST_IDS = 1_000_000


def count_characters(text: Column, characters: str) -> Column:
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_words(words: Column, h: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first one included.

    A window's hash and place share one long (as few bits for the place as the text needs), so that equal
    windows become neighbours in one sort of plain longs, n log n for texts of any length. Windows that
    look equal are compared word by word with their next two neighbours on either side."""

    def sorted_windows(mask: Column) -> Column:
        pack = lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 3), pack))

    def starts(mask: Column, s: Column) -> Column:
        near = lambda x, y: x.bitwiseXOR(y) <= mask
        close = lambda x, y: F.coalesce(near(x, y) & (x.bitwiseXOR(y) >= 0), F.lit(False))
        maybe = F.filter(s, lambda x, k: close(x, F.get(s, k + 1)) | close(x, F.get(s, k - 1)))
        return let(F.transform(maybe, lambda x: x.bitwiseAND(mask).cast("int")), same_words)

    def same_words(p: Column) -> Column:
        """p: places in the order of their hashes."""
        word = lambda i, d: F.get(words, i + d)
        equal = lambda i, j: F.coalesce((i != j) & (word(i, 0) == word(j, 0)) & (word(i, 1) == word(j, 1)) & (word(i, 2) == word(j, 2)), F.lit(False))
        return F.array_sort(F.filter(p, lambda i, k: equal(i, F.get(p, k + 1)) | equal(i, F.get(p, k - 1)) | equal(i, F.get(p, k + 2)) | equal(i, F.get(p, k - 2))))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    bits = F.length(F.bin(F.size(h).cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    found = let(mask, lambda m: let(sorted_windows(m), lambda s: let(starts(m, s), covered)))
    return F.when(F.size(h) > 3, found).otherwise(F.lit(0).cast("long"))


def pair_hashes(h: Column) -> Column:
    """Hashes of neighbours; the last word has none."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, k: F.xxhash64(x, F.get(h, k + 1)))


def bucket(h: Column, buckets: int) -> Column:
    """buckets is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def trusted_flag(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents with `trusted`: true where labels marks the row as good."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    if labels.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return documents.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def ratio_model(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> list[float]:
    """log(target/raw) by bucket (buckets: a power of two); both multinomials are counted over all documents."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    marked = trusted_flag(documents.select("doc_id", "text"), labels)
    grams = let(hashes(space_words(whole(F.col("text")))), lambda h: F.concat(h, pair_hashes(h)))
    placed = marked.select("trusted", F.explode(grams).alias("h")).select("trusted", bucket(F.col("h"), buckets).alias("bucket"))
    counted = placed.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum(F.col("trusted").cast("int")).alias("good")).collect()
    raw, good = [smoothing] * buckets, [0.0] * buckets
    for r in counted:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    if not sum(good):
        return [0.0] * buckets
    # The target's prior is the raw multinomial with the weight of `smoothing * buckets` n-grams: rare buckets stay near 0.
    share, prior = 1 / sum(raw), smoothing * buckets
    shift = 1 / (sum(good) + prior)
    return [math.log((g + prior * r * share) * shift / (r * share)) for g, r in zip(good, raw)]


def judge(documents: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every document."""
    weights, buckets = doubles(model), len(model)
    text = whole(F.col("text"))
    words = documents.select("doc_id", text.alias("text"), space_words(text).alias("words"))

    def sums(h: Column) -> Column:
        add = lambda grams: F.aggregate(grams, F.lit(0.0), lambda a, x: a + F.get(weights, bucket(x, buckets)))
        n = F.greatest(2 * F.size(h) - 1, F.lit(1))
        return F.struct(((add(h) + add(pair_hashes(h))) / n).alias("score"), repeated_words(F.col("words"), h).alias("n_repeat_words"))

    judged = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_characters(F.col("text"), SYMBOLS).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        let(hashes(F.col("words")), sums).alias("x"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "x.n_repeat_words", "x.score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
