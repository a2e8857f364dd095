"""Items that stand in texts word for word.

Cases: null and empty items, and null texts, match nothing; an item counts the rows of texts that hold it, repeated rows each;
repeated items are counted each; extra columns are not passed on; empty tables give no texts, or no items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Items that each batch of texts is searched for; more of them go in several passes.
ITEM_LIMIT = 10_000


def anchors(items: DataFrame) -> DataFrame:
    """items (item_id, item) with `anchor`: the longest blank-separated word inside the item (not its first or last, which a text
    may continue), the first of equals; null if there is none."""
    words = F.split("item", " ")
    inner = F.filter(F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)), lambda w: w != "")
    longest = F.array_max(F.transform(inner, F.length))
    return items.withColumn("anchor", F.get(F.filter(inner, lambda w: F.length(w) == longest), F.lit(0)))


def exact_presence(texts: DataFrame, items: DataFrame, limit: int = ITEM_LIMIT) -> DataFrame:
    """item_id and n_docs, the number of texts that hold the item, zero too.

    A text that holds an item holds its anchor as a blank-separated word, so texts meet items by an equal join on anchors, and only
    these pairs are compared in full. Items without an anchor (one or two words) are few words to look for, and are compared with all."""
    named = items.select(F.monotonically_increasing_id().alias("_row"), "item_id", "item")
    rows = sorted(named.collect(), key=lambda r: r["_row"]) if items.count() <= limit else None
    if rows is None:
        many = -(-items.count() // limit)
        parts = [items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(many)) == b) for b in range(many)]
        out = [exact_presence(texts, p, max(limit, p.count())) for p in parts]
        found = out[0]
        for x in out[1:]:
            found = found.unionByName(x)
        return found
    fixed = items.sparkSession.createDataFrame([(r["_row"], r["item_id"], r["item"]) for r in rows], f"_row long, item_id {dict(items.dtypes)['item_id']}, item string")
    keyed = anchors(fixed).where(F.length("item") > 0)
    wanted = sorted({r["anchor"] for r in keyed.select("anchor").collect() if r["anchor"]})
    words = F.array_intersect(F.split("text", " "), F.lit(wanted) if wanted else F.array().cast("array<string>"))
    met = texts.select("text", F.explode(words).alias("anchor")).join(F.broadcast(keyed.where("anchor is not null")), "anchor")
    hits = met.where(F.col("text").contains(F.col("item"))).groupBy("_row").agg(F.count("*").alias("n"))
    short = keyed.where("anchor is null").drop("anchor")
    if not short.isEmpty():
        held = texts.select("text").join(F.broadcast(short), F.col("text").contains(F.col("item")))
        hits = hits.unionByName(held.groupBy("_row").agg(F.count("*").alias("n")))
    return fixed.join(hits, "_row", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))
