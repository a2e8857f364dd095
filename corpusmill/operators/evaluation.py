"""Scores of answered questions, a row each and over all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metrics as M, text as T

Metric = Callable[[Column, Column], Column]


def short_scores(rows: DataFrame, pred: str = "output", gold: str = "answer") -> DataFrame:
    """rows with accuracy, f1, precision, recall and em; a gold answer's alternatives are joined into one."""
    p, g = M.short_prediction(F.col(pred)), M.joined_gold(F.col(gold))
    return _scored(rows, M.token_f1(p, g), M.accuracy(p, g), M.exact_match(p, g))


def best_scores(rows: DataFrame, pred: str = "output", gold: str = "answer") -> DataFrame:
    """The same, with the best of a gold answer's alternatives for each score."""
    p, g = M.short_prediction(F.col(pred)), F.col(gold)
    return _scored(rows, M.best_f1(p, g), M.accuracy_multi(p, g), M.exact_match_multi(p, g))


def _scored(rows: DataFrame, f1: Column, accuracy: Column, em: Column) -> DataFrame:
    """rows with the scores; columns of their names are replaced."""
    named = rows.withColumns({"_f": f1, "_accuracy": accuracy, "_em": em.cast("int")})
    kept = [c for c in rows.columns if c not in SHORT]
    return named.select(*kept, F.col("_accuracy").alias("accuracy"), "_f.f1", "_f.precision", "_f.recall", F.col("_em").alias("em"))


#: Scores of short answers, and of each suite.
SHORT = ("accuracy", "f1", "precision", "recall", "em")
SCORES = {"short": SHORT, "short_best": SHORT, "close_set": ("em",), "long_asqa": ("str_em", "str_hit"), "long_narrative": ("bleu_1", "bleu_4", "bleu", "bleu_smoothed")}


def means(scored: DataFrame, names: tuple[str, ...] = SHORT) -> DataFrame:
    """Averages in percent, and the number of right answers that the accuracy stands for, if it is one of them."""
    out = scored.agg(F.count("*").alias("n"), *(F.coalesce(100 * F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in names))
    if "accuracy" not in names:
        return out
    return out.withColumn("correct_answers", F.floor(F.round(F.col("accuracy") * F.col("n") / 100, 6)))


def fallback_means(rows: DataFrame, pred: str = "output", gold: str = "answer") -> DataFrame:
    right = M.fallback_right(F.col(pred), F.col(gold)).cast("int")
    return rows.agg(F.count("*").alias("n"), F.coalesce(100 * F.avg(right), F.lit(0.0)).alias("accuracy"))


def option_scores(rows: DataFrame, chosen: str = "extract_output", gold: str = "answer_idx") -> DataFrame:
    """Multiple choice: the extracted option against the right one."""
    return rows.withColumn("em", M.exact_match(F.col(chosen), F.col(gold)).cast("int"))


def presence_scores(rows: DataFrame, pred: str = "prediction", pairs: str = "qa_pairs") -> DataFrame:
    """Long answers: share of short answers that stand in them, and whether all do; the text is cut to its first words."""
    sets = F.transform(pairs, lambda q: q["short_answers"])
    return rows.withColumn("_s", M.string_em(F.col(pred), sets)).withColumns({"str_em": F.col("_s.share"), "str_hit": F.col("_s.hit"), "cut": T.strip_punctuation(T.first_words(F.col(pred)))}).drop("_s")


def bleu_scores(rows: DataFrame, pred: str = "output", gold: str = "answer") -> DataFrame:
    c = F.col("_c")
    scored = rows.withColumn("_c", M.bleu_counts(F.col(pred), F.col(gold)))
    return scored.select(*(x for x in rows.columns if x not in SCORES["long_narrative"]), M.bleu_score(c, (1, 0, 0, 0)).alias("bleu_1"), M.bleu_score(c, (0, 0, 0, 1)).alias("bleu_4"), M.bleu_score(c).alias("bleu"), M.bleu_score(c, epsilon=0.1).alias("bleu_smoothed"))


#: Suites by the kind of data set.
SUITES: dict[str, Callable[..., DataFrame]] = {"short": short_scores, "short_best": best_scores, "close_set": option_scores, "long_asqa": presence_scores, "long_narrative": bleu_scores}


def best_of(pred: Column, golds: Column, metric: Metric) -> Column:
    """The best value of any metric over an array of gold answers, to two places."""
    return F.round(F.array_max(F.transform(golds, lambda g: metric(pred, g).cast("double"))), 2)
