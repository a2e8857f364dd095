"""Plain Python versions of the contracts, for comparison."""

import re

from corpusmill.llm import license_scan as L

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def quality_rules(text):
    t = text or ""
    w = words(t)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed)


def license_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def license_base(text):
    w = license_words(text)
    at, labels = [], set()
    for phrase, label in L.BASE_PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return (len(w), len(at), min(at, default=None), max(at, default=None), labels)


def license_labels(text, index):
    """Every template at every place."""
    w = license_words(text)
    out = set()
    for t, own in enumerate(index.words):
        for at in range(-len(own), len(w)):
            fits = lambda p, x, at=at: 0 <= at + p < len(w) and w[at + p] == x
            votes = sum(fits(p, x) for x, k, p in index.postings if k == t)
            if votes >= index.votes[t] and all(fits(p, x) for p, x in index.keys[t]):
                out.add(index.labels[t])
    return out


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if not cut else (rest[: cut.start()], rest[cut.start() :])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", tail, maxsplit=1)[0]
