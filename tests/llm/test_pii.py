"""PII: the contract's own expressions, and the corpus counts in plain dictionaries."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st

from corpusmill.llm import pii, queries
from corpusmill.session import Scratch, cut
from tests.llm import brute, fixtures

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m)]
        total = sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and total % 10 == 0 else []
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("a.Z@-+% 01259()é"), max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_spans_in_known_text():
    text = "a.b+c@x-y.example.com, 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (555) 123-4567; 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255"
    assert pii.base_spans(text) == slow_base(text)
    assert {k for k, _, _ in pii.base_spans(text)} == set(pii.KINDS)


def test_long_texts_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000, "a.b" * 100_000 + "@"):
        pii.base_spans(text)


def test_many_spans_are_linear():
    text = "word 1.2.3.4 and a@b.cd " * 50_000
    spans = pii.base_spans(text)
    began = time.time()
    assert len(spans) == 100_000 and len(pii.text_terms(text, spans)) == 100_000 and len(pii.protected(text, spans)) == 6
    assert time.time() - began < 20


def slow_secrets(text):
    base, out = slow_base(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text or ""):
        changes = sum((x.isdigit() and y.isalpha()) or (x.isalpha() and y.isdigit()) for x, y in zip(m[0], m[0][1:]))
        if len(m[0]) >= 20 and changes >= 5 and not any(a < m.end() and m.start() < b for _, a, b in base):
            out.append(("secret", *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 2.@=-"), max_size=80))
def test_secrets(text):
    assert pii.secret_spans(text, pii.base_spans(text)) == slow_secrets(text)


def slow_words(text, spans):
    """(term, start, end) of a text's terms, letter by letter."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and (text[end].isalnum() if text[end] < "\x80" else True):
            end += 1
        if 3 <= end - at <= 64 and not re.search("[0-9]", text[at:end]) and not any(a < end and at < b for _, a, b in spans):
            out.append((re.sub("[A-Z]", lambda m: m[0].lower(), text[at:end]), at, end))
        at = max(end, at + 1)
    return out if spans else []


def slow_protected(text, spans):
    """Values and classes, by the docstring."""
    out = set()
    for kind, a, b in spans:
        digits, value = re.sub("[^0-9]", "", text[a:b]), text[a:b].lower()
        out |= {kind}
        if kind == "email":
            out |= {f"email:{value}", "email@" + value.split("@")[-1]}
        elif kind == "ip":
            parts = [str(int(p)) for p in value.split(".")]
            out |= {"ip:" + ".".join(parts), "ip/" + ".".join(parts[:2])}
        elif kind in ("card", "phone"):
            out |= {f"{kind}:{digits}", f"{kind}/{digits[: 6 if kind == 'card' else 4]}"}
        else:
            out |= {f"secret:{value}"}
    return out


def slow_risky(texts, disclosure=0.9, support=3):
    """(entity, term) -> share over all rows, and per row its spans and terms."""
    n, n_t, n_e, n_te, backed, own = len(texts), Counter(), Counter(), Counter(), defaultdict(set), []
    for text in (t or "" for t in texts):
        spans = slow_base(text) + slow_secrets(text)
        words, held = slow_words(text, spans), slow_protected(text, spans)
        own.append((spans, words, held))
        n_t.update(set(brute.license_words(text)))
        n_e.update(held)
        for pair in {(e, t) for e in held for t, _, _ in words}:
            n_te[pair] += 1
            backed[pair].add(text)
    share = lambda e, t: math.log(n_te[e, t] * n / n_t[t] / n_e[e]) / math.log(n / n_e[e]) if n > n_e[e] else 0
    return {p: share(*p) for p in n_te if len(backed[p]) >= support and share(*p) >= disclosure}, own


def slow_find(texts):
    risky, own = slow_risky(texts)
    out = []
    for spans, words, held in own:
        out.append([*spans, *(("term", a, b) for t, a, b in words if any((e, t) in risky for e in held))])
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def corpus():
    out = [f"please contact zorblatt manager at agent@corp.example.com about order {w} today" for w in ("alpha", "beta", "gamma", "delta")]
    out += [f"the weather {w} was fine today and order came" for w in ("one", "two", "three", "four", "five", "six")] * 3
    out += [f"call Quibblo at {w}@home.example.org today order" for w in ("ann", "ben", "cyd")]
    out += [f"secret handshake {c}1{c}2{c}3{c}4{c}5{c}6{c}7{c}8{c}9{c}0 order" for c in "abcd"]
    return out + ["zeta reveals 10.1.2.3 here"] * 5 + [None, ""]


def frame(spark, texts, ids=None):
    rows = list(zip(ids if ids is not None else range(len(texts)), texts))
    return spark.createDataFrame(rows, "doc_id long, text string")


def judged(docs):
    found = cut(pii.scan(docs))
    return {(r["entity"], r["term"]): r["share"] for r in pii.risky_terms(docs, found, pii.different_texts(Scratch(docs.sparkSession), found)).collect()}


def test_risky_terms_and_find(spark):
    texts = corpus()
    docs = frame(spark, texts)
    want, _ = slow_risky(texts)
    got = judged(docs)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {("email:agent@corp.example.com", "zorblatt"), ("email@home.example.org", "quibblo"), ("secret", "handshake")} <= want.keys() and not any(t in ("order", "today", "the") for _, t in want)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert spans == {k: joined(x) for k, x in enumerate(slow_find(texts))}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[4] == texts[4] and clean[len(texts) - 2] is None
    assert clean[25].endswith("[SECRET] order") and "handshake" not in clean[25]


def test_ids_play_no_part(spark):
    """Rows stored twice under one id, null ids, and extra columns with the helpers' names."""
    texts = corpus() * 2
    want = Counter(joined(x) for x in slow_find(texts))
    for ids in ([k % 30 for k in range(len(texts))], [None] * len(texts)):
        docs = frame(spark, texts, ids)
        assert Counter(r["spans"] for r in pii.find(docs).collect()) == want and any("term:" in x for x in want)
        extra = docs.selectExpr("*", "1 as h", "2 as terms", "3 as term", "4 as words", "5 as protected", "6 as _h2")
        clean = pii.sanitise(extra)
        assert clean.columns == extra.columns and Counter(r["text"] for r in clean.collect()) == Counter(r["text"] for r in pii.sanitise(docs).collect())


def test_joins_by_shuffle_agree(spark, monkeypatch):
    docs = frame(spark, corpus())
    want = sorted(map(tuple, pii.find(docs).collect()))
    monkeypatch.setattr(pii, "BROADCAST", 0)
    assert sorted(map(tuple, pii.find(docs).collect())) == want


def test_terms_far_from_their_entity(spark):
    """Co-occurrence is counted by document, and a revealing term goes wherever it stands in a text that holds the entity."""
    far = " ".join(["filler words of no interest"] * 6)
    texts = [f"zorblatt {far} agent@corp.example.com {w} {far} Zorblatt {far} zorblatt" for w in ("alpha", "beta", "gamma")]
    texts += ["filler words of no interest to anyone"] * 40
    docs = frame(spark, texts)
    risky = judged(docs)
    assert risky.keys() == {(e, "zorblatt") for e in ("email", "email@corp.example.com", "email:agent@corp.example.com")} and all(math.isclose(x, 1.0) for x in risky.values())
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i, text in enumerate(texts[:3]):
        places = [m.span() for m in re.finditer("[Zz]orblatt", text)]
        assert spans[i].split(",")[1:] == [f"term:{a}:{b}" for a, b in places] and len(places) == 3
        assert "zorblatt" not in clean[i].lower() and "[EMAIL]" in clean[i]
    assert clean[10] == texts[10]


def test_rewrite():
    assert pii.rewrite("mail a@b.cd now 1.2.3.4!", []) == "mail [EMAIL] now [IP]!"
    assert pii.rewrite("abc Def ghi", [(0, 3, 0.95), (4, 7, 0.95), (8, 11, 1.0)]) == "[WORD] [NAME] "
    assert pii.rewrite("+1 555 123 4567 8", []) == "[PHONE]"


def test_awkward_documents(spark):
    docs = fixtures.documents(spark)
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert sorted(rows) == list(range(len(fixtures.TEXTS)))
    for i, t in enumerate(fixtures.TEXTS):
        want = slow_base(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert tuple(rows[i][f"n_{k}"] for k in pii.KINDS) == tuple(sum(x[0] == k for x in want) for k in pii.KINDS)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and rows[i]["spans"].startswith(joined)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 0").first()["text"] is None
    assert pii.find(fixtures.empty(spark)).collect() == [] and pii.sanitise(fixtures.empty(spark)).collect() == []
    twice = spark.createDataFrame([(None, "x 1.2.3.4"), (None, "x 1.2.3.4"), (7, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_ip"]) for r in pii.find(twice).collect()) == [(0, 1), (0, 1), (7, 0)]


def test_query(spark):
    """The whole result, method and all, against plain Python."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_pii"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r, spans in zip(rows, slow_find([r["text"] for r in rows])):
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(joined(slow_base(r["text"])).encode()).hexdigest()
        assert got[r["doc_id"]]["spans"] == joined(spans)
    assert sum("term:" in r["spans"] for r in got.values()) > 0
