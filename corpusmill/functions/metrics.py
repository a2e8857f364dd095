"""Column builders that score predicted answers against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as T

YES_NO = ["yes", "no", "noanswer"]


def _matched(own: Column, other: Column) -> Column:
    """Entries in both, as multisets: one walk over both sorted together, own entries first."""
    tagged = lambda a, k: F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(k).alias("k")))
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(a: Column, y: Column) -> Column:
        left = F.when(y["x"].eqNullSafe(a["x"]), a["left"]).otherwise(0)
        hit = ((y["k"] == 1) & (left > 0)).cast("int")
        return F.struct(y["x"].alias("x"), F.when(y["k"] == 0, left + 1).otherwise(left - hit).alias("left"), (a["n"] + hit).alias("n"))

    return F.aggregate(F.sort_array(F.concat(tagged(own, 0), tagged(other, 1))), start, step, lambda a: a["n"])


def token_f1(pred: Column, gold: Column) -> Column:
    """struct(f1, precision, recall) of normalised tokens; a yes, no or noanswer that isn't matched scores 0."""
    p, g = T.normalize_answer(pred), T.normalize_answer(gold)

    def scored(x: Column) -> Column:
        a, b = F.array_remove(F.split(x["p"], " "), ""), F.array_remove(F.split(x["g"], " "), "")
        guard = (x["p"] != x["g"]) & (x["p"].isin(YES_NO) | x["g"].isin(YES_NO))
        same = F.when(guard, 0).otherwise(_matched(a, b))
        precision = F.when(same > 0, same / F.size(a)).otherwise(0.0)
        recall = F.when(same > 0, same / F.size(b)).otherwise(0.0)
        f1 = F.when(same > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        return F.struct(f1.alias("f1"), precision.alias("precision"), recall.alias("recall"))

    return T.let(F.struct(p.alias("p"), g.alias("g")), scored)


def exact_match(pred: Column, gold: Column) -> Column:
    return T.normalize_answer(pred) == T.normalize_answer(gold)


def accuracy(pred: Column, gold: Column) -> Column:
    """1 where the answer is right, in order: one contains the other; all parts of a short hyphenated gold stand in the
    prediction; a common word of three letters or more where either side has at most three; a common number."""
    p, g = T.normalize_answer(pred), T.normalize_answer(gold)
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[\\p{L}\\p{N}_]{3,}"), 0))
    digits = lambda x: F.regexp_extract_all(x, F.lit("\\p{Nd}+"), 0)

    def right(x: Column) -> Column:
        p, g = x["p"], x["g"]
        parts = F.filter(F.transform(F.split(x["raw"], "-"), T.normalize_answer), lambda y: y != "")
        hyphen = x["raw"].contains("-") & (F.size(F.split(x["raw"], "-")) <= 3) & F.forall(parts, lambda y: p.contains(y))
        few = F.least(F.size(x["pw"]), F.size(x["gw"])) <= 3
        return (p == g) | p.contains(g) | g.contains(p) | hyphen | (F.arrays_overlap(x["pw"], x["gw"]) & few) | F.arrays_overlap(digits(p), digits(g))

    both = T.let(F.struct(p.alias("p"), g.alias("g"), T.blank(gold).alias("raw")), lambda x: F.struct(x["p"].alias("p"), x["g"].alias("g"), x["raw"].alias("raw"), words(x["p"]).alias("pw"), words(x["g"]).alias("gw")))
    return T.let(both, right).cast("int")


def alternatives(gold: Column) -> Column:
    """Stripped, non-empty candidates of a gold answer that `|` separates."""
    return F.filter(F.transform(F.split(T.blank(gold), "\\|"), T.strip), lambda x: x != "")


def accuracy_multi(pred: Column, gold: Column) -> Column:
    """1 where any alternative is right."""
    return F.exists(alternatives(gold), lambda g: accuracy(pred, g) == 1).cast("int")


def best_f1(pred: Column, gold: Column) -> Column:
    """The best alternative's struct(f1, precision, recall); zeros where there is none."""
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return F.coalesce(F.array_max(F.transform(alternatives(gold), lambda g: token_f1(pred, g))), zero)


def exact_match_multi(pred: Column, gold: Column) -> Column:
    return F.exists(alternatives(gold), lambda g: exact_match(pred, g))


def fallback_right(pred: Column, gold: Column) -> Column:
    """The looser test of the report path: false for empty texts; then containment, hyphenated parts, or an end of a range."""
    p, g, raw = T.normalize_loose(pred), T.normalize_loose(gold), T.blank(gold)
    parts = F.filter(F.transform(F.split(raw, "-"), T.strip), lambda y: y != "")
    hyphen = raw.contains("-") & (F.size(F.split(raw, "-")) <= 3) & F.forall(parts, lambda y: p.contains(T.normalize_loose(y)))
    ends = F.split(raw, "\\s*[-–]\\s*")
    span = (raw.contains(" - ") | raw.contains("–")) & (F.size(ends) == 2) & F.exists(ends, lambda y: p.contains(T.normalize_loose(y)))
    return F.when((T.blank(pred) == "") | (raw == ""), False).otherwise(p.contains(g) | g.contains(p) | hyphen | span)


def short_prediction(pred: Column) -> Column:
    """Bars and line ends become blanks."""
    return F.translate(T.blank(pred), "|\n", "  ")


def joined_gold(gold: Column) -> Column:
    return F.array_join(F.split(T.blank(gold), "\\|"), " ")


def ngrams(a: Column, n: int) -> Column:
    some = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.array_join(F.slice(a, i + 1, n), " "))
    return F.when(F.size(a) >= n, some).otherwise(F.array().cast("array<string>"))


def bleu_counts(pred: Column, gold: Column, orders: int = 4) -> Column:
    """struct(p, g, same): white-space tokens of either side, and the n-grams in both for n from 1 to orders."""
    both = F.struct(T.tokens(pred).alias("p"), T.tokens(gold).alias("g"))
    return T.let(both, lambda x: F.struct(F.size(x["p"]).alias("p"), F.size(x["g"]).alias("g"), F.array(*(_matched(ngrams(x["p"], n), ngrams(x["g"], n)) for n in range(1, orders + 1))).alias("same")))


def bleu_score(counts: Column, weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), epsilon: float | None = None) -> Column:
    """Sentence BLEU of bleu_counts(); with epsilon, an n-gram precision of 0 counts as epsilon / n-grams."""
    p, g, total = counts["p"], counts["g"], F.lit(0.0)
    for n, w in enumerate(weights, 1):
        if not w:
            continue
        same, many = counts["same"][n - 1].cast("double"), F.greatest(p - (n - 1), F.lit(1))
        hit = F.when(same > 0, same).otherwise(F.lit(epsilon or 0.0))
        total = total + w * F.log(F.when(hit > 0, hit / many))
    brevity = F.when(p > g, 0.0).otherwise(1 - g / p)
    return F.when((p == 0) | (counts["same"][0] == 0), 0.0).otherwise(F.coalesce(F.exp(brevity + total), F.lit(0.0)))


def bleu(pred: Column, gold: Column, weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), epsilon: float | None = None) -> Column:
    """Sentence BLEU of white-space tokens."""
    return T.let(bleu_counts(pred, gold, len(weights)), lambda x: bleu_score(x, weights, epsilon))


def string_em(context: Column, answer_sets: Column) -> Column:
    """struct(share, hit) of the sets (arrays of answers) of which some answer stands in the context, normalised."""
    norm = T.normalize_answer(context)
    held = F.transform(answer_sets, lambda s: F.exists(s, lambda a: norm.contains(T.normalize_answer(a))).cast("int"))
    return T.let(held, lambda h: F.struct((F.aggregate(h, F.lit(0), lambda a, x: a + x) / F.size(h)).alias("share"), (F.array_min(h) == 1).alias("hit")))
