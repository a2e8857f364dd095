"""License scans: fixed phrases, then a positional rare-token index over notice templates.

Native: DataFrame functions only, two narrow scans; only document counts of the templates' words (a
bounded vocabulary) are shuffled and reach the driver.

The index holds, for each template, its `rare` words of highest inverse document frequency, with their
positions; frequencies are counted over all documents. Each text's indexed words fetch postings; a posting
and the place of the word give the place where the template would start. Postings that agree on
(template, place) are intersected by sorting, and an alignment with enough of them is verified: every
mandatory key phrase must stand, word for word, at its relative position. Work is n log n in the text.

Cases: a null text is empty: no words, no labels, score 0, null positions. Texts are read whole; repeated
rows are judged alike, row by row; equal frequencies order by word. Extra columns are not passed on. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, let, whole

BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: The contract's phrases and their labels.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Wording of public licence notices, and the phrases that each must hold.
TEMPLATES = [
    Template("mit", "released under the MIT License", ("MIT License",)),
    Template("mit", "licensed under the MIT License", ("MIT License",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("hereby granted", "free of charge")),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", ("Apache License", "Version 2.0")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("General Public License", "version 3")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("General Public License", "version 2")),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("Lesser General Public License",)),
    Template("agpl", "licensed under the GNU Affero General Public License", ("Affero General Public License",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms", "are permitted")),
    Template("bsd", "licensed under the BSD License", ("BSD License",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("CC BY-NC",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("CC BY-SA",)),
    Template("cc-by-nd", "licensed under CC BY-ND 4.0", ("CC BY-ND",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("Public Domain Dedication",)),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited", ("unauthorized copying", "strictly prohibited")),
]


def tokens(text: str) -> list[str]:
    """The words of a template; the same rule as words()."""
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(whole(text)), BREAK), "")


def word_frequencies(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the templates; at most one row a word reaches the driver."""
    seen = documents.select(F.explode(F.array_distinct(F.filter(words(F.col("text")), lambda w: w.isin(vocabulary)))).alias("w"))
    return {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}


@dataclass(frozen=True)
class Index:
    """postings: (word, template, position); votes: what each template's alignments need."""

    postings: list[tuple[str, int, int]]
    votes: list[int]
    keys: list[list[tuple[int, str]]]
    words: list[list[str]]
    labels: list[str]


def build_index(templates: list[Template], frequencies: dict[str, int], rare: int = 4, least: int = 2) -> Index:
    postings, votes, keys, texts = [], [], [], []
    for t, template in enumerate(templates):
        own = tokens(template.text)
        rank = sorted(set(own), key=lambda w: (math.log1p(frequencies.get(w, 0)), w))[:rare]
        postings += [(w, t, p) for p, w in enumerate(own) if w in rank]
        votes.append(min(least, len(rank)))
        placed = []
        for phrase in map(tokens, template.keys):
            at = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
            placed += [(at + i, w) for i, w in enumerate(phrase)]
        keys.append(placed)
        texts.append(own)
    return Index(postings, votes, keys, texts, [t.label for t in templates])


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def base_places(w: Column) -> list[Column]:
    """For each fixed phrase, the places where its words stand one after another."""

    def places(phrase: list[str]) -> Column:
        def stands(i: Column) -> Column:
            fits = F.get(w, i) == phrase[0]
            for k, x in enumerate(phrase[1:], 1):
                fits = fits & F.coalesce(F.get(w, i + k) == x, F.lit(False))
            return fits

        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), stands)

    return [places(tokens(p)) for p, _ in BASE_PHRASES]


def alignments(w: Column, index: Index) -> Column:
    """Verified (template, share of its words that stand in place)."""
    rare = sorted({p[0] for p in index.postings})
    by_word = _literal({r: [{"t": t, "p": p} for x, t, p in index.postings if x == r] for r in rare}, "map<string,array<struct<t:int,p:int>>>")
    votes, keys = _literal(index.votes, "array<int>"), _literal([[{"p": p, "w": x} for p, x in k] for k in index.keys], "array<array<struct<p:int,w:string>>>")
    full = _literal(index.words, "array<array<string>>")
    hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(rare))
    fetched = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(by_word, F.get(w, i)), lambda e: F.struct(e["t"].alias("t"), (i - e["p"]).alias("at"), e["p"].alias("p")))))

    def agreed(s: Column) -> Column:
        same = lambda a, b: (a["t"] == b["t"]) & (a["at"] == b["at"])
        last = lambda x, k: F.get(s, k + F.get(votes, x["t"]) - 1)
        enough = lambda x, k: F.coalesce(same(x, last(x, k)), F.lit(False)) & ~F.coalesce(same(x, F.get(s, k - 1)), F.lit(False))
        return F.filter(s, enough)

    stands = lambda x, p, v: F.coalesce(F.get(w, x["at"] + p) == v, F.lit(False))
    verified = F.filter(let(F.sort_array(fetched), agreed), lambda x: F.forall(F.get(keys, x["t"]), lambda k: stands(x, k["p"], k["w"])))

    def share(x: Column) -> Column:
        own = F.get(full, x["t"])
        found = F.aggregate(F.transform(own, lambda v, p: stands(x, p, v).cast("int")), F.lit(0), lambda a, y: a + y)
        return F.struct(x["t"].alias("t"), (found / F.size(own)).alias("share"))

    return F.transform(verified, share)


def scan(documents: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    score: the largest share of a verified template's words that stand in place; 1 where a fixed phrase is found."""
    vocabulary = sorted({w for t in templates for w in tokens(t.text)})
    index = build_index(templates, word_frequencies(documents, vocabulary))
    split = documents.select("doc_id", words(F.col("text")).alias("w"))
    labels = _literal(index.labels, "array<string>")
    names = F.array(*[F.lit(x) for _, x in BASE_PHRASES])

    def read(w: Column) -> Column:
        some = F.size(w) > 0
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(some, F.array(*base_places(w))).otherwise(F.array(*[F.array().cast("array<int>") for _ in BASE_PHRASES])).alias("base"),
            F.when(some, alignments(w, index)).otherwise(F.array().cast("array<struct<t:int,share:double>>")).alias("found"),
        )

    found = split.select("doc_id", let(F.col("w"), read).alias("x")).select("doc_id", "x.*")
    places = F.flatten("base")
    base = F.filter(names, lambda x, k: F.size(F.get(F.col("base"), k)) > 0)
    own = F.transform("found", lambda x: F.get(labels, x["t"]))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(best).alias("score"),
    )


def oracle(templates: list[Template] = TEMPLATES, rare: int = 4, least: int = 2) -> str:
    """DuckDB SQL: every template word against every word of every text, then the same votes and keys."""
    index = build_index(templates, {})
    q = lambda s: "'" + s.replace("'", "''") + "'"
    places = ", ".join(f"({t}, {p}, {q(w)}, {str((p, w) in index.keys[t]).lower()})" for t, own in enumerate(index.words) for p, w in enumerate(own))
    labels = ", ".join(f"({t}, {q(x)}, {len(index.words[t])}, {len(index.keys[t])})" for t, x in enumerate(index.labels))
    fixed = ", ".join(q(w) for text, _ in BASE_PHRASES for w in tokens(text))
    starts = " union all ".join(
        f"select doc_id, a.i, {q(label)} label from word a {' '.join(f'join word b{k} using (doc_id)' for k in range(1, len(p)))} where a.w = {q(p[0])} and {' and '.join(f'b{k}.w = {q(x)} and b{k}.i = a.i + {k}' for k, x in enumerate(p) if k)}"
        for p, label in ((tokens(text), label) for text, label in BASE_PHRASES)
    )
    return f"""
with split as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}'), lambda x: x <> '') ws from documents),
place(t, p, w, is_key) as (values {places}),
template(t, label, n, n_keys) as (values {labels}),
word as (select * from (select doc_id, unnest(ws) w, unnest(range(0, len(ws))) i from split) where w in (select w from place) or w in ({fixed})),
df as (select w, count(distinct doc_id) n from word group by w),
ranked as (select t, w, row_number() over (partition by t order by coalesce(n, 0), w) r, count(*) over (partition by t) words from (select distinct t, w from place) left join df using (w)),
aligned as (
  select doc_id, place.t, i - p as start_at, count(*) filter (r <= {rare}) votes, count(*) filter (is_key) keys, count(*) hits, any_value(words) words
  from word join place using (w) join ranked on ranked.t = place.t and ranked.w = place.w group by all),
found as (
  select doc_id, label, hits / n as share from aligned join template using (t) where votes >= least({least}, least({rare}, words)) and keys = n_keys),
base as ({starts}),
counted as (select doc_id, count(*) n_base, min(i) first_word, max(i) last_word, list_sort(list_distinct(list(label))) names from base group by doc_id),
own as (select doc_id, list(label) names, max(share) share from found group by doc_id)
select s.doc_id, len(ws) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(array_to_string(c.names, ','), '') base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(c.names, []), coalesce(o.names, [])))), ','), '') labels,
       case when n_base > 0 then 1.0 else coalesce(share, 0) end::double score
from split s left join counted c using (doc_id) left join own o using (doc_id)"""
