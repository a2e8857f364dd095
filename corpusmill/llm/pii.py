"""PII: fixed patterns, then terms that the corpus shows to reveal what the patterns protect.

Free style (Arrow batches) for the texts, DataFrame operations for the counts. What is protected:

* the values that the patterns find (e-mail, IP, card, phone), and secrets: long unbroken tokens that keep changing between
  letters and digits, as keys and digests do;
* their classes, as a term may give away the class of a value though each value stands once: the kind, an e-mail's domain, an
  IP's network, a card's issuer, a phone's prefix.

A term is a word of a text that holds a protected value: 3 to 64 characters, no digit, outside all spans. Over all rows, with
n(t) rows whose text holds term t, n(e) holding the value or class e, n(t,e) holding both, and N rows,
PMI(t;e) = log(n(t,e) N / n(t) n(e)) is the information that t gives about e, and IC(e) = log(N / n(e)) all
there is to give. A term whose share PMI/IC reaches the disclosure threshold, with n(t,e) backed by enough
different texts, is a span too, wherever it stands in a text that holds e. sanitise() generalises such a term to its
class of writing ([NAME] or [WORD]), or removes it where the share reaches the removal threshold.

Scale: texts are read three times, row by row, and never shuffled; only different texts that hold a value, as their words, and
counts are. All counting is done on different texts, with the number of their rows as weight, so copies travel once. Pairs that the
count of a term among these texts already rules out go before n(t) is counted. Tables of few rows are broadcast, checked
by count; larger ones are joined by shuffle. Every pattern is run in a form that is linear in the text.

Cases: a null text is empty and has no spans; spans count code points. Ids play no part: rows with equal texts, whatever
their ids (repeated or null), get the same spans each; equal texts count once as support, and every row counts in n and N. What stands
in every row reveals nothing (IC 0). Extra columns of any name are kept by sanitise() and dropped by find(). Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch, cut, drop
from . import license_scan
from .common import whole

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
DISCLOSURE = 0.9
REMOVAL = 0.999
SUPPORT = 3
#: Rows (and entries of their lists) that are broadcast; beyond, a shuffle join.
BROADCAST = 200_000
#: Shortest secret, and how often it changes between letters and digits at least.
SECRET_LENGTH, CHANGES = 20, 5
#: Longest name of a protected value; beyond, its digest stands for it.
NAME = 100
#: Texts of an Arrow batch that are worked on at once.
TEXTS = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start at the start of a run of digits: the one before took all of its last run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SECRET_LENGTH)
_CHANGE = re.compile("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each "@" outwards."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _number(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def _is_ip(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(match: str) -> bool:
    n = _number(match)
    return 13 <= len(n) <= 19 and luhn(n)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_number(m[0])) <= 15]
    return out


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free(starts: list[int], ends: list[int], s: int, e: int) -> bool:
    k = bisect_right(ends, s)
    return not (k < len(ends) and starts[k] < e)


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Secrets that touch no span of base."""
    starts, ends = _merged(base)
    found = (m.span() for m in _TOKEN.finditer(text) if sum(1 for _ in _CHANGE.finditer(m[0])) >= CHANGES)
    return [(SECRET, a, b) for a, b in found if _free(starts, ends, a, b)]


def entity(kind: str, value: str) -> str:
    """One spelling for one protected value."""
    if kind == "ip":
        return "ip:" + ".".join(p.lstrip("0") or "0" for p in value.split("."))
    return f"{kind}:{_number(value) if kind in ('card', 'phone') else value.translate(_LOWER)}"


def classes(kind: str, value: str) -> list[str]:
    """The classes of a protected value, the wider first."""
    name = entity(kind, value)
    narrow = {"email": lambda: "email@" + name.rpartition("@")[2], "ip": lambda: "ip/" + ".".join(name[3:].split(".")[:2]), "card": lambda: "card/" + name[5:11], "phone": lambda: "phone/" + name[6:10]}
    return [kind, narrow[kind]()] if kind in narrow else [kind]


def protected(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The different values and classes that a text holds."""
    found = {x for kind, a, b in spans for x in (entity(kind, text[a:b]), *classes(kind, text[a:b]))}
    return sorted(x if len(x) <= NAME else x[:16] + hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in found)


def text_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms of a text."""
    if not spans:
        return []
    starts, ends = _merged(spans)
    places = (m.span() for m in _WORD.finditer(text))
    return [(text[s:e].translate(_LOWER), s, e) for s, e in places if 3 <= e - s <= 64 and not _DIGIT.search(text, s, e) and _free(starts, ends, s, e)]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "doc_id long, h long, h2 long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, secrets string, protected array<string>, words array<struct<term:string,start:int,end:int>>"


def _lists(values: list[list], kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """(ends, values) of a list array."""
    return pa.array(list(accumulate(map(len, values), initial=0)), pa.int32()), pa.array([x for v in values for x in v], kind)


def scan(documents: DataFrame) -> DataFrame:
    """One row a document: its id, two hashes of the text, the patterns' spans, the secrets, and, of texts that have any, what is
    protected and the terms beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                yield _scanned(batch.slice(at, TEXTS))

    text = whole(F.col("text"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(text), text.alias("text")).mapInArrow(run, _FOUND)


def _scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: list[list[int]] = [[] for _ in KINDS]
    base, digest, secrets, held, terms = [], [], [], [], []
    for text in batch.column(3).to_pylist():
        spans = base_spans(text)
        for k, kind in enumerate(KINDS):
            counts[k].append(sum(s[0] == kind for s in spans))
        base.append(_joined(spans))
        digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
        own = secret_spans(text, spans)
        secrets.append(_joined(own))
        held.append(protected(text, spans + own))
        terms.append(text_terms(text, spans + own))
    ends, names = _lists([[t for t, _, _ in x] for x in terms], pa.string())
    starts, stops = (pa.array([y[k] for x in terms for y in x], pa.int32()) for k in (1, 2))
    words = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([names, starts, stops], ["term", "start", "end"]))
    columns = [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(digest, pa.string()), pa.array(secrets, pa.string()), pa.ListArray.from_arrays(*_lists(held, pa.string())), words]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "h2", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "secrets", "protected", "words"])


def _hashes(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2")


def _small(table: DataFrame, size: Column | None = None) -> DataFrame:
    """A written table, to be broadcast if it has few rows (and, by size, few entries)."""
    n, entries = table.agg(F.count("*"), F.sum(size if size is not None else F.lit(1))).first()
    return F.broadcast(table) if max(n, entries or 0) <= BROADCAST else table


def different_texts(scratch: Scratch, found: DataFrame) -> DataFrame:
    """h, h2, docs (its rows), protected and words of every different text that holds something protected."""
    held = found.where(F.size("protected") > 0)
    return scratch.put(held.groupBy("h", "h2").agg(F.count("*").alias("docs"), F.first("protected").alias("protected"), F.first("words").alias("words")), "texts")


def risky_terms(documents: DataFrame, found: DataFrame, texts: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term, share) of the terms that reveal a protected value or class; found is the written result of scan(), texts that
    of different_texts()."""
    scratch, total = Scratch(documents.sparkSession), float(found.count())
    backed = texts.select("docs", F.explode("protected").alias("entity")).groupBy("entity").agg(F.sum("docs").alias("n_e"), F.count("*").alias("texts"))
    # A pair has no more different texts than its entity.
    known = scratch.put(backed.where((F.col("texts") >= support) & (F.col("n_e") < total)).select("entity", "n_e"), "known")
    terms = F.array_distinct(F.col("words.term"))
    met = texts.select("docs", terms.alias("terms"), F.explode("protected").alias("entity")).join(_small(known), "entity")
    once = met.select("entity", "n_e", "docs", F.explode("terms").alias("term")).groupBy("entity", "n_e", "term").agg(F.sum("docs").alias("n_te"), F.count("*").alias("texts"))
    # The most rows that may hold the term, if the pair is to reach the threshold.
    most = F.col("n_te") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - disclosure))
    pairs = scratch.put(once.where(F.col("texts") >= support).withColumn("most", most).drop("texts"), "pairs")
    among = texts.select("docs", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("docs").alias("here"))
    left = scratch.put(pairs.join(among, "term").where(F.col("here") <= F.col("most") * (1 + 1e-9)).drop("here", "most"), "left")
    wanted = scratch.put(left.select("term").distinct(), "terms")
    words = documents.select(F.explode(F.array_distinct(license_scan.words(F.col("text")))).alias("term"))
    n_t = scratch.put(words.join(_small(wanted), "term").groupBy("term").agg(F.count("*").alias("n_t")), "frequencies")
    information = F.log(F.lit(total) / F.col("n_e"))
    pmi = F.log(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    risky = scratch.put(left.join(n_t, "term").select("entity", "term", (pmi / information).alias("share")).where(F.col("share") >= disclosure), "risky")
    scratch.drop(known, pairs, left, wanted, n_t)
    return risky


def term_spans(texts: DataFrame, risky: DataFrame) -> DataFrame:
    """h, h2 and terms (start, end, share, in order) of the texts that hold a risky term and what it reveals."""
    scratch = Scratch(texts.sparkSession)
    reveals = scratch.put(risky.groupBy("term").agg(F.collect_list(F.struct("entity", "share")).alias("reveals")), "reveals")
    met = texts.select("h", "h2", "protected", F.explode("words").alias("x")).select("h", "h2", "protected", "x.*").join(_small(reveals, F.size("reveals")), "term")
    best = F.array_max(F.transform(F.filter("reveals", lambda r: F.array_contains("protected", r["entity"])), lambda r: r["share"]))
    rows = met.withColumn("share", best).where("share is not null")
    return scratch.put(rows.groupBy("h", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms")), "spans")


def _revealing(documents: DataFrame, found: DataFrame, disclosure: float, support: int) -> DataFrame:
    """h, h2 and terms of the texts with risky terms; broadcast if they are few."""
    scratch = Scratch(documents.sparkSession)
    texts = different_texts(scratch, found)
    risky = risky_terms(documents, found, texts, disclosure, support)
    spans = term_spans(texts, risky)
    scratch.drop(texts, risky)
    return _small(spans, F.size("terms"))


def find(documents: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, the patterns' counts and digest, and spans (the patterns', secrets' and terms') of every document."""
    found = cut(scan(documents), "found")
    rows = found.drop("protected", "words").join(_revealing(documents, found, disclosure, support), ["h", "h2"], "left")
    own = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,share:double>>")), lambda x: F.concat_ws(":", F.lit(TERM), x["start"], x["end"]))
    spans = F.array_join(F.filter(F.concat(F.array("base", "secrets"), own), lambda x: x != ""), ",")
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"))


def generalised(word: str) -> str:
    """A term's class of writing."""
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def rewrite(text: str, terms: list[tuple[int, int, float]], removal: float = REMOVAL) -> str:
    """Values and secrets become [KIND]; risky terms their class, or nothing from the removal threshold on. Of spans that overlap,
    the one that starts first (then the longer) names the whole stretch."""
    base = base_spans(text)
    marks = sorted([(a, -b, f"[{k.upper()}]") for k, a, b in base + secret_spans(text, base)] + [(a, -b, "" if share >= removal else generalised(text[a:b])) for a, b, share in terms])
    out, at, end = [], 0, 0
    for a, b, mark in marks:
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, -b)
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, removal: float = REMOVAL) -> DataFrame:
    """The same rows and columns, with every span of `text` generalised or removed; a null text stays null."""
    columns, names = documents.columns, ["_pii_h", "_pii_h2", "_pii_terms"]
    found = cut(scan(documents), "found")
    terms = _revealing(documents, found, disclosure, support).toDF(*names)
    drop(found)
    keyed = documents.select(*columns, *(h.alias(n) for h, n in zip(_hashes(whole(F.col("text"))), names)))

    @F.arrow_udf("string")
    def clean(texts: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), TEXTS):
            marks = ([] if x is None else [(y["start"], y["end"], y["share"]) for y in x] for x in terms.slice(at, TEXTS).to_pylist())
            out.append(pa.array([None if t is None else rewrite(t, m, removal) for t, m in zip(texts.slice(at, TEXTS).to_pylist(), marks)], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return keyed.join(terms, names[:2], "left").withColumn("text", clean("text", names[2])).select(*columns)
