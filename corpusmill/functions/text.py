"""Column builders over strings: answer normalisation, tokens, names, escapes, extraction of JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: ASCII punctuation as a character class, the articles that answers drop, the phrases that make a
#: predicate too vague, the markers that end a description, and the data sets that paths are searched for.
PUNCTUATION = "[!-/:-@\\[-`{-~]"
ARTICLES = ["a", "an", "the"]
VAGUE = ["related to", "relates to", "associated with", "connected to", "linked to", "relevant to", "pertains to", "concerns"]
DATASETS = ["musique", "quality", "hotpot", "nq", "triviaqa"]
SPACES = "(?U)\\s+"
#: The characters that (?U)\\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it: Spark repeats an expression in each place that names it."""
    return F.transform(F.array(value), body)[0]


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space of any kind becomes single blanks, none at the ends."""
    return strip(F.regexp_replace(text, SPACES, " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    bare = F.regexp_replace(F.lower(blank(text)), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, f"(?U)\\b({'|'.join(ARTICLES)})\\b", " "))


def normalize_loose(text: Column) -> Column:
    """Punctuation becomes blanks; articles stay."""
    return squeeze(F.lower(F.regexp_replace(blank(text), PUNCTUATION, " ")))


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.array_remove(F.split(blank(text), SPACES), "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def truncate(text: Column, n: int = 512) -> Column:
    return F.substring(blank(text), 1, n)


def strip_punctuation(text: Column) -> Column:
    """Without punctuation at the end."""
    return F.regexp_replace(text, f"{PUNCTUATION}+$", "")


def first_words(text: Column, n: int = 100) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def class_id(name: Column) -> Column:
    """PascalCase without signs: `DNA Repair` becomes DnaRepair, nothing becomes UnknownClass."""
    words = F.regexp_replace(strip(F.regexp_replace(strip(blank(name)), "[^\\p{L}\\p{N}_\\s-]", "")), "[\\s\\-]+", " ")
    return let(F.replace(F.initcap(words), F.lit(" "), F.lit("")), lambda made: F.when(strip(made) == "", "UnknownClass").otherwise(made))


def property_id(name: Column) -> Column:
    """camelCase; signs and hyphens vanish: `regulated by` becomes regulatedBy, nothing becomes unknownRelation."""
    words = squeeze(F.regexp_replace(blank(name), "[^\\p{L}\\p{N}_\\s]", ""))

    def made(w: Column) -> Column:
        head = F.substring_index(w, " ", 1)
        rest = F.replace(F.initcap(F.substring(w, F.length(head) + 2, F.length(w))), F.lit(" "), F.lit(""))
        return F.when(w == "", "unknownRelation").otherwise(F.concat(F.lower(head), rest))

    return let(words, made)


def clean_description(text: Column) -> Column:
    """What stands before the first marker of relations."""
    return strip(F.get(F.split(blank(text), "关系[:：]|Relations?[:：]|Relationships?[:：]", 2), F.lit(0)))


def xml_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def turtle_escape(text: Column) -> Column:
    for sign, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def found_json(text: Column) -> Column:
    """struct(text, object): the object in a ```json fence; else one with a list of "ontologies" inside other text; else the text without
    outer white space; and whether it is an object. Each candidate is parsed once."""
    one = lambda t, is_object: F.struct(t.alias("text"), is_object.alias("object"))

    def inside(t: Column, whole: Column) -> Column:
        bare = F.regexp_extract(t, '(?s)(\\{[^{}]*"ontologies"[^{}]*\\[.*?\\]\\s*\\})', 1)
        # The shortest match may end at an inner list; the longest one then holds the object.
        longest = F.regexp_extract(t, '(?s)(\\{[^{}]*"ontologies"[^{}]*\\[.*\\]\\s*\\})', 1)
        return let(bare, lambda b: F.when(b == "", one(whole, F.lit(False))).when(is_json_object(b), one(b, F.lit(True))).otherwise(let(longest, lambda x: one(x, is_json_object(x)))))

    def bare(t: Column) -> Column:
        return let(strip(t), lambda whole: F.when(is_json_object(whole), one(whole, F.lit(True))).otherwise(inside(t, whole)))

    def fenced(t: Column) -> Column:
        found = F.when(t.contains("```json"), F.regexp_extract(t, "(?s)```json\\s*(\\{.*?\\})\\s*```", 1)).otherwise("")
        return let(found, lambda f: F.when(f != "", one(f, is_json_object(f))).otherwise(bare(t)))

    return let(blank(text), fenced)


def fenced_json(text: Column) -> Column:
    """The text of found_json()."""
    return found_json(text)["text"]


def is_json_object(text: Column) -> Column:
    return let(strip(blank(text)), lambda t: t.startswith("{") & F.coalesce(F.try_parse_json(t).isNotNull(), F.lit(False)))


def has_keys(text: Column, keys: list[str]) -> Column:
    """Not blank; and where the fenced part is an object, it has all keys."""
    held = lambda found: F.coalesce(F.json_object_keys(found), F.array().cast("array<string>"))
    every = lambda found: let(held(found), lambda h: F.forall(F.lit(keys), lambda k: F.array_contains(h, k)))
    full = lambda t: (strip(t) != "") & let(found_json(t), lambda found: ~found["object"] | every(found["text"]))
    return let(blank(text), full)


def dataset_of_index(path: Column) -> Column:
    """Data set named by a path: a parent folder, a file that starts with `test`, or a part of the file's name."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    parent = F.lower(F.regexp_extract(path, "([^/]*)/[^/]*$", 1))
    out = F.when(stem.startswith("test"), "test").when(parent.isin(DATASETS + ["test"]), parent)
    for d in DATASETS + ["test"]:
        out = out.when(stem.contains(d), d)
    return out.otherwise("unknown")


def dataset_of_report(path: Column) -> Column:
    """The same for reports: else the file name's part before the first underscore."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    parent = F.lower(F.regexp_extract(path, "([^/]*)/[^/]*$", 1))
    out = F.when(parent.isin(DATASETS), parent)
    for d in DATASETS:
        out = out.when(stem.contains(d), d)
    return out.otherwise(F.substring_index(stem, "_", 1))
