"""Text and metric columns against plain Python."""

import math
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import metrics as M, text as T, vectors as V
from corpusmill.operators import concepts, evaluation
from corpusmill.plans import catalog


def norm(s):
    s = "".join(c for c in (s or "").lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def f1(p, g):
    p, g = norm(p), norm(g)
    if p != g and (p in ("yes", "no", "noanswer") or g in ("yes", "no", "noanswer")):
        return 0.0
    a, b = p.split(), g.split()
    n = sum((Counter(a) & Counter(b)).values())
    return 2 * n / (len(a) + len(b)) if n else 0.0


def accuracy(p, g):
    a, b = norm(p), norm(g)
    if a == b or a in b or b in a:
        return 1
    if "-" in g and len(g.split("-")) <= 3 and all(norm(x) in a for x in g.split("-") if norm(x)):
        return 1
    wa, wb = set(re.findall(r"\w{3,}", a)), set(re.findall(r"\w{3,}", b))
    if wa & wb and min(len(wa), len(wb)) <= 3:
        return 1
    return int(bool(set(re.findall(r"\d+", a)) & set(re.findall(r"\d+", b))))


PAIRS = [
    ("The  Cat's, a hat!", "cats hat"), ("x", ""), ("", "x"), ("yes", "yes sir"), ("about 18 years of age overall", "range covering 18 through 20"), ("the fifth largest city", "fifth-largest"),
    ("Café à the-end a été", "a été Café"), ("one two three four five", "five six seven eight nine ten"), ("a b a b", "b a a"), ("“the” word", "word"), ("no", "noanswer"), ("twenty", "30"), ("a-b-c-d x", "a-b-c-d"), ("l’a dit", "dit"),
]


def test_normalisation_and_scores(spark):
    rows = spark.createDataFrame(PAIRS, "p string, g string")
    got = rows.select("p", "g", T.normalize_answer(F.col("p")).alias("n"), M.token_f1(F.col("p"), F.col("g"))["f1"].alias("f"), M.accuracy(F.col("p"), F.col("g")).alias("a"), M.exact_match(F.col("p"), F.col("g")).alias("e")).collect()
    for r in got:
        assert r["n"] == norm(r["p"]), r
        assert math.isclose(r["f"], f1(r["p"], r["g"]), abs_tol=1e-12), r
        assert r["a"] == accuracy(r["p"], r["g"]), r
        assert r["e"] == (norm(r["p"]) == norm(r["g"]))


@pytest.mark.parametrize(
    "make, given, want",
    [
        (T.class_id, "DNA Repair", "DnaRepair"), (T.class_id, "---", "UnknownClass"), (T.class_id, None, "UnknownClass"), (T.class_id, "used-in place!", "UsedInPlace"),
        (T.property_id, "regulated by", "regulatedBy"), (T.property_id, "used-in", "usedin"), (T.property_id, "", "unknownRelation"), (T.property_id, "Is PART Of", "isPartOf"),
        (T.clean_description, "text\nRelations: x", "text"), (T.clean_description, "文 关系：x", "文"), (T.xml_escape, "<a & 'b'>\"", "&lt;a &amp; &apos;b&apos;&gt;&quot;"), (T.turtle_escape, 'a"\\\n', 'a\\"\\\\\\n'),
        (T.fenced_json, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'), (T.fenced_json, " plain ", "plain"), (T.strip_punctuation, "end.!?", "end"), (T.normalize_loose, "The a-b, C", "the a b c"),
        (T.preview, "x" * 201, "x" * 200 + "..."), (T.preview, "x" * 200, "x" * 200), (T.truncate, "y" * 600, "y" * 512), (T.token_count, " a  b c ", 3), (T.token_count, None, 0),
        (T.is_json_object, '{"a": 1}', True), (T.is_json_object, "[1]", False), (T.is_json_object, "{a", False), (T.dataset_of_index, "/data/hotpot/corpus.json", "hotpot"), (T.dataset_of_index, "/x/test_nq.json", "test"),
        (T.dataset_of_index, "/x/my_nq.json", "nq"), (T.dataset_of_index, "/x/other.json", "unknown"), (T.dataset_of_report, "/x/other_1.json", "other"),
    ],
)
def test_text_functions(spark, make, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(make(F.col("x"))).first()[0] == want


def test_keys_and_alternatives(spark):
    rows = spark.createDataFrame([('```json\n{"a": 1, "b": 2}\n```',), ('{"a": 1}',), ("text",), ("",)], "x string")
    assert [r[0] for r in rows.select(T.has_keys(F.col("x"), ["a", "b"])).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([("the red fox", "blue | red fox| ")], "p string, g string")
    r = rows.select(M.accuracy_multi(F.col("p"), F.col("g")), M.best_f1(F.col("p"), F.col("g"))["f1"], M.exact_match_multi(F.col("p"), F.col("g"))).first()
    assert tuple(r) == (1, 1.0, True)


def test_fallback(spark):
    rows = [("", "x", False), ("about 18 years old", "18 - 20", True), ("fifth largest", "fifth-largest", True), ("x y", "z", False), ("12–14", "14", True), ("!", "x", True)]
    got = spark.createDataFrame([r[:2] for r in rows], "p string, g string").select(M.fallback_right(F.col("p"), F.col("g"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def bleu(p, g, weights, epsilon=None):
    p, g = p.split(), g.split()
    if not p or not set(p) & set(g):
        return 0.0
    total = 0.0
    for n, w in enumerate(weights, 1):
        if not w:
            continue
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, g))
        hit = sum((a & b).values()) or epsilon or 0
        if not hit:
            return 0.0
        total += w * math.log(hit / max(1, sum(a.values())))
    return math.exp(min(0, 1 - len(g) / len(p)) + total)


def test_bleu(spark):
    rows = [("the cat sat on the mat", "the cat sat on a mat"), ("a b c d", "a b c d"), ("a b", "a b c"), ("x", "y"), ("", "y"), ("a b c d e f", "f e d c b a")]
    frame = spark.createDataFrame(rows, "p string, g string")
    for weights, epsilon in (((1, 0, 0, 0), None), ((0.25,) * 4, None), ((0.25,) * 4, 0.1), ((0, 0, 0, 1), 0.1)):
        got = [r[0] for r in frame.select(M.bleu(F.col("p"), F.col("g"), weights, epsilon)).collect()]
        assert got == pytest.approx([bleu(p, g, weights, epsilon) for p, g in rows])


def test_bleu_query_scores_whole_texts(spark):
    """Every pair of the registered query, with its texts uncut; and a long pair that differs beyond the first words."""
    sf = "/root/testdata/sf0.001"
    said = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'assistant'").collect()}
    pairs = {(c, t): (x, said[c, t + 2]) for (c, t), x in said.items() if (c, t + 2) in said}
    assert any(len(x.split()) > 30 for p in pairs.values() for x in p)
    got = {(r["conv_id"], r["turn"]): r for r in catalog.QUERIES["bleu"](spark, sf).collect()}
    assert got.keys() == pairs.keys()
    for key, (p, g) in pairs.items():
        want = [bleu(p, g, w, e) for w, e in (((1, 0, 0, 0), None), ((0, 0, 0, 1), None), ((0.25,) * 4, None), ((0.25,) * 4, 0.1))]
        assert [got[key][c] for c in ("bleu_1", "bleu_4", "bleu", "bleu_smoothed")] == pytest.approx(want, abs=1e-6)
    p, g = "a b c d e " * 400, "a b c d e " * 390 + "f g h " * 20
    row = spark.createDataFrame([(p, g)], "output string, answer string")
    assert evaluation.bleu_scores(row).first()["bleu"] == pytest.approx(bleu(p, g, (0.25,) * 4))


def test_string_em(spark):
    rows = spark.createDataFrame([("The Red fox, 12 years.", [["red fox", "x"], ["13"]])], "c string, s array<array<string>>")
    assert tuple(rows.select(M.string_em(F.col("c"), F.col("s")).alias("r")).select("r.*").first()) == (0.5, False)


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(V.cosine(F.col("a"), F.col("b")), V.distance(F.col("a"), F.col("b")), V.unit(F.col("a"))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == pytest.approx(2**0.5) and got[0][2] == pytest.approx([0.6, 0.8])
    assert got[1][0] == 0.0 and got[1][2] == [0.0, 0.0]


def test_strip_takes_what_the_pattern_took(spark):
    codes = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select("id", F.concat(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')")).alias("c"))
    padded = codes.select(F.concat("c", F.lit("x"), "c", F.lit("y"), "c").alias("t"), "c")
    other = padded.where(~T.strip("t").eqNullSafe(F.regexp_replace("t", "(?U)^\\s+|\\s+$", "")) | ((F.length(T.strip("c")) == 0) != F.col("c").rlike("(?U)^\\s$")))
    assert codes.count() == 63487 and other.count() == 0


def test_texts_are_parsed_once(spark):
    """Spark repeats an expression wherever it is named; a response's text was found and parsed again for every check of it."""
    rows = spark.createDataFrame([("{}",)], "r string")
    for made in (concepts.response_error(F.col("r")), T.has_keys(F.col("r"), ["a"])):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("```json\\s") == 1 and plan.count("from_json") <= 1 and plan.count("json_object_keys") + plan.count("jsonObjectKeys") <= 1
    given = ["", None, "{}", " {\"a\": 1} ", "{\"b\": 1}", "x", "```json\n{\"a\": 2}\n```", "```json\n{broken}\n```", "so: {\"ontologies\": []} .", "{\"ontologies\": [1]"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, r string").select("k", T.has_keys(F.col("r"), ["a"]).alias("x"), concepts.response_error(F.col("r")).alias("e")).orderBy("k").collect()
    assert [r["x"] for r in got] == [False, False, False, True, False, True, True, True, False, True]
    wrong, none = "not a JSON object", "no ontologies"
    assert [r["e"] for r in got] == [wrong, wrong, none, none, none, wrong, none, wrong, none, wrong]
