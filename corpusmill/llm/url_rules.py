"""URL filters: prefix rules by host and path, then pattern rules found by their rarest literal token.

Native: DataFrame functions only, one narrow pass, no shuffle of the pages.

Pattern rules are written as in public filter lists: "*" any characters, "^" a separator or the end,
a leading "||" the start of a host label, a leading "@@" an exception that allows. A literal token is a
maximal run of [a-z0-9] in a pattern whose two neighbours are fixed and can't continue it, so a URL
that the rule matches holds it as a whole token. Each rule is filed under the one of its tokens that
the corpus has least often; a URL's tokens fetch candidates from a hash table, and only these run a
regular expression. Rules without such a token are candidates for every URL.

Cases: a null url, or one without "://", has an empty host and path and no prefix rule; patterns see
the url as it is (null: empty). Repeated rows are judged alike, row by row. Extra columns of the input
are not passed on. An empty table gives an empty result. Long urls are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, whole

URL_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class PrefixRule:
    """host and its subdomains, for paths that start with path."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The fixed rules of the contract.
BASE_RULES = [
    PrefixRule("org", "/", "allow"),
    PrefixRule("example.org", "/es/", "block"),
    PrefixRule("example.org", "/en/1", "block"),
    PrefixRule("com", "/fr/", "allow"),
    PrefixRule("com", "/de/", "block"),
]

#: The pattern rules of the production query.
PATTERN_RULES = [
    "||cheap-pills.",
    "||spam-farm.",
    "||casino.",
    "||free-casino.",
    "||adult-cams.",
    "||payday-loans.",
    "||replica-watches.",
    "://ads.",
    "://adserver.",
    "/banners/*.gif^",
    "/wp-login.php^",
    "/cgi-bin/",
    "/porn/",
    "/torrent/",
    "/cart/checkout^",
    "/link-exchange/",
    "?sessionid=*&sort=",
    "&affid=*&subid=",
    ".exe^",
    ".apk^",
    "@@://ads.txt.",
    "@@/casino/history/",
]


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    action: str
    regex: str
    tokens: tuple[str, ...]


def parse_pattern(rule: str) -> PatternRule:
    """The rule's regular expression, for lower-cased urls, and its whole literal tokens."""
    action, body = ("allow", rule[2:]) if rule.startswith("@@") else ("block", rule)
    body = body.lower()
    start = body.startswith("||")
    body = body[2:] if start else body
    regex = "^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.])?" if start else ""
    for c in body:
        regex += {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c, c if c.isalnum() else "[" + c + "]" if c not in "^\\[]" else "\\" + c)
    fixed = [m for m in re.finditer("[a-z0-9]+", body)]
    ends = lambda m: (start if m.start() == 0 else body[m.start() - 1] != "*") and m.end() < len(body) and body[m.end()] != "*"
    return PatternRule(rule, action, "(?s)" + regex, tuple(dict.fromkeys(m[0] for m in fixed if ends(m))))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where "://" is missing."""
    url = whole(url)
    return ascii_lower(F.regexp_extract(url, URL_PARTS, 1)), F.regexp_extract(url, URL_PARTS, 2)


def longest_rule(host: Column, path: Column, rules: list[PrefixRule], value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(whole(url)), F.lit("[a-z0-9]+"), 0))


def token_counts(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """How many of all urls hold each of the rules' tokens; as many rows as the rules have tokens."""
    if not tokens:
        return {}
    held = pages.select(F.explode(url_tokens(F.col(url))).alias("token")).where(F.col("token").isin(tokens))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_table(rules: list[PatternRule], counts: dict[str, int]) -> tuple[list[list[int]], list[int]]:
    """Slots of rule numbers by the hash of each rule's rarest token; rules that have none."""
    size = 1 << max(4, (2 * len(rules)).bit_length())
    slots: list[list[int]] = [[] for _ in range(size)]
    always = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            slots[xxhash.xxh64(rarest.encode(), seed=42).intdigest() % size].append(k)
        else:
            always.append(k)
    return slots, always


def filter_urls(pages: DataFrame, prefix_rules: list[PrefixRule], patterns: list[str], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict and pattern (the pattern rule that decided, else null) of every row.

    The prefix rules' verdict holds where one fits. Else a matching exception allows, a matching
    pattern blocks (of several, the first in the list is named), and default holds for the rest."""
    rules = [parse_pattern(p) for p in patterns]
    counts = token_counts(pages, url, sorted({t for r in rules for t in r.tokens}))
    slots, always = rule_table(rules, counts)
    host, path = split_url(F.col(url))
    out = pages.select(F.col(key).alias("page_id"), ascii_lower(whole(F.col(url))).alias("u"), host.alias("host"), path.alias("path"))
    out = out.withColumn("rule", longest_rule(F.col("host"), F.col("path"), prefix_rules, lambda r: r.name))
    table = F.from_json(F.lit(str(slots)), "array<array<int>>")
    regexes = F.from_json(F.lit(_json([r.regex for r in rules])), "array<string>")
    fetched = F.flatten(F.transform(url_tokens(F.col("u")), lambda t: table[F.pmod(F.xxhash64(t), F.lit(len(slots))).cast("int")]))
    fetched = F.array_union(fetched, F.from_json(F.lit(str(always)), "array<int>"))
    hit = F.filter(fetched, lambda k: F.rlike(F.col("u"), F.get(regexes, k)))
    #: Exceptions come first, then the order of the list.
    rank = F.array_min(F.transform(hit, lambda k: k + F.get(F.from_json(F.lit(str([0 if r.action == "allow" else len(rules) for r in rules])), "array<int>"), k)))
    out = out.withColumn("rank", F.when(F.col("rule").isNull(), rank))
    names = F.from_json(F.lit(_json([r.pattern for r in rules])), "array<string>")
    by_rule = longest_rule(F.col("host"), F.col("path"), prefix_rules, lambda r: r.action)
    by_pattern = F.when(F.col("rank").isNull(), F.lit(default)).when(F.col("rank") < len(rules), "allow").otherwise("block")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce(by_rule, by_pattern).alias("verdict"),
        F.get(names, F.pmod(F.col("rank"), F.lit(max(1, len(rules))))).alias("pattern"),
    )


def _json(values: list[str]) -> str:
    import json

    return json.dumps(values)


def oracle(prefix_rules: list[PrefixRule], patterns: list[str], default: str = "allow") -> str:
    """DuckDB SQL that runs every rule on every url."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = {q(r.host)} or ends_with(host, {q('.' + r.host)})) and starts_with(path, {q(r.path)})"
    longest = sorted(prefix_rules, key=lambda r: (-len(r.name), r.name))
    case = lambda value: "case " + " ".join(f"when {fits(r)} then {q(value(r))}" for r in longest) + " end"
    rules = [parse_pattern(p) for p in patterns]
    ranked = [r for r in rules if r.action == "allow"] + [r for r in rules if r.action == "block"]
    hits = lambda value: "case " + " ".join(f"when regexp_matches(u, {q(r.regex)}) then {q(value(r))}" for r in ranked) + " end"
    parts = q(URL_PARTS)
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with parts as (
  select page_id, {low("coalesce(url, '')")} as u,
         {low(f"regexp_extract(coalesce(url, ''), {parts}, 1)")} as host,
         regexp_extract(coalesce(url, ''), {parts}, 2) as path
  from pages),
ruled as (select *, {case(lambda r: r.name)} as rule, {case(lambda r: r.action)} as fixed from parts)
select page_id, host, path, rule,
       coalesce(fixed, {hits(lambda r: r.action)}, {q(default)}) as verdict,
       case when rule is null then {hits(lambda r: r.pattern)} end as pattern
from ruled"""
