"""Sentence chunks of long texts, and the corpus rows made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut, drop


def sentences(text: Column) -> Column:
    """Stripped, non-empty pieces between runs of . ! and ?; the signs are lost."""
    return F.filter(F.transform(F.split(T.blank(text), "[.!?]+"), T.strip), lambda s: s != "")


def chunks(text: Column, least: int = 300, most: int = 500) -> Column:
    """Sentences packed in order: a chunk ends when the next sentence would lift it over `most` tokens and it has at least
    `least`; the rest is the last chunk."""
    sized = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), T.token_count(s).cast("int").alias("n")))
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] + x["n"] > most) & (a["n"] >= least)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x["s"])).otherwise(F.concat(a["cur"], F.array(x["s"]))).alias("cur"),
            F.when(full, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
        )

    def finish(a: Column) -> Column:
        every = F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
        return F.transform(every, lambda c: F.array_join(c, " "))

    return F.aggregate(sized, empty, step, finish)


def running_ids(rows: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """rows with numbers from 0 in the given order, which ought to be total. Range partitions are sorted and written once; only
    their sizes meet in one place. rows are written first, as the ranges are taken from a sample, for which they would be made twice."""
    made = cut(rows, "rows")
    sorted_rows = cut(made.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    drop(made)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    return sorted_rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + place).drop("_part", "_start", "_at")


def corpus_rows(documents: DataFrame, key: str, text: str, short: int = 150, least: int = 300, most: int = 500) -> DataFrame:
    """key, part (from 0), parts, title and context: texts of at most `short` tokens pass whole, others are chunked."""
    of = lambda whole, parts: F.transform(parts, lambda c: F.struct(whole.alias("whole"), F.size(parts).alias("parts"), c.alias("context")))
    cut_up = lambda whole: F.when(whole, F.array(T.blank(F.col(text)))).otherwise(chunks(F.col(text), least, most))
    # Exploded where it is made: of a column, Spark would first test the size, and make it again for that.
    made = T.let(T.token_count(F.col(text)) <= short, lambda whole: T.let(cut_up(whole), lambda parts: of(whole, parts)))
    rows = documents.select(F.col(key).alias("key"), F.posexplode(made).alias("part", "c")).select("key", "part", "c.*")
    name = F.concat(F.lit("Document "), F.col("key").cast("string"))
    title = F.when(F.col("whole"), name).otherwise(F.concat(name, F.lit(" - Part "), (F.col("part") + 1).cast("string")))
    return rows.select("key", "part", "parts", title.alias("title"), "context", (F.col("part") == 0).alias("is_supporting"))
