"""Awkward documents that every operator must handle."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("words", T.StringType()), T.StructField("kept", T.StringType())])

PROSE = "a quick brown fox jumps over the lazy dog while seven small birds sing in the old green garden near the river bank at dawn "
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "one two three",
    PROSE * 3,
    PROSE * 3,
    "".join(f"word{i} " for i in range(300)),
    "same line here\nsame line here\n \nother\nsame line here\n\n",
    "All rights reserved. Licensed under CC BY-NC 4.0. cc by",
    "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
    "x" * 50_000,
    "ab " * 30_000,
    "Ünïcödé ÀÉ 漢字 テスト 😀 emoji\u00a0nbsp\u2028sep " * 20,
    "write to a.b@x.example.com or 10.0.0.1 and 4111 1111 1111 1111 or +1 (555) 123-4567 now",
    "write to a.b@x.example.com, 999.1.1.1, 1.2.3.4.5.6.7.8 and 4111111111111112 or +12",
    "# * $ % & | < > " * 10,
    "'s 're don't won't I'll   spaces   \n\n\n tail   ",
]


def documents(spark, extra=()):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src0", len(t or ""), "x", None, "y") for i, t in enumerate([*TEXTS, *extra])]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
