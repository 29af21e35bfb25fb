import pytest
from pyspark.sql import functions as F

from cardmill.functions import quality, scores, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, want",
    [("  Hello   World ", "hello world"), ("<b>Bold</b> text", "bold text"), ("Ｆｕｌｌ　Ｗｉｄｔｈ", "full width"), ("a\n\tb", "a b"), ("", ""), (None, None), ("x y", "x y")],
)
def test_normal(spark, raw, want):
    assert one(spark, raw, text.normal) == want


def test_normal_format(spark):
    assert one(spark, " A &amp; <i>B</i>&nbsp;C ", text.normal_format) == "A & B C"


@pytest.mark.parametrize(
    "raw, intent, key",
    [
        ("What is a CDN?", "definition", "definition::cdn"),
        ("¿Qué es un CDN?", "definition", "definition::cdn"),
        ("Define CDN", "definition", "definition::cdn"),
        ("What does CDN mean?", "definition", "definition::cdn"),
        ("Azure CDN vs CloudFront", "comparison", "comparison::azure cdn::cloudfront"),
        ("Difference between CloudFront and Azure CDN", "comparison", "comparison::azure cdn::cloudfront"),
        ("What does EC2 stand for?", "acronym", "acronym::ec2"),
        ("¿Qué significan las siglas EC2?", "acronym", "acronym::ec2"),
        ("What is a CDN (content delivery network)?", "definition", "definition::cdn"),
        ("Advantages of a CDN", "unknown", None),
    ],
)
def test_question_keys(spark, raw, intent, key):
    words = lambda c: text.words_only(text.without_brackets(text.unaccented(text.normal(c))))
    assert one(spark, raw, lambda c: text.question_key(words(c))[0]) == intent
    assert one(spark, raw, lambda c: text.question_key(words(c))[1]) == key


@pytest.mark.parametrize("token, want", [("networking", "network"), ("provisioning", "provision"), ("provision", "provis"), ("definiciones", "definicion"), ("policies", "policy"), ("does", "doe"), ("as", "as"), ("compare", "compar"), ("indices", "indic")])
def test_stem(spark, token, want):
    assert one(spark, token, text.stem) == want


def test_tokens_content_trigrams(spark):
    assert one(spark, "what is the load balancer", lambda c: text.content(text.tokens(c))) == ["balanc", "load"]
    assert one(spark, "ab", text.trigrams) == ["  a", " ab", "ab ", "b  "]
    assert one(spark, " ", text.trigrams) == []


def test_tags_and_decks(spark):
    assert tuple(one(spark, " a :: b::c ", text.parse_tag)) == ("a", "b::c")
    assert one(spark, "a::", text.parse_tag) is None and one(spark, "plain", text.parse_tag) is None
    assert one(spark, "Ámbito::Sub deck:: ::X-1", text.deck_parts) == ["ambito", "sub deck", "x 1"]


def test_calibration(spark):
    for c, want in ((0.1, 0), (0.2, 0), (0.4, 0.75), (0.55, 0.90), (0.68, 0.97), (1.0, 1.0)):
        assert one(spark, c, scores.calibrate, "double") == pytest.approx(want)
    for s in (0.1, 0.5, 0.75, 0.8, 0.9, 0.95, 0.99):
        assert one(spark, scores.cosine_floor(s), scores.calibrate, "double") == pytest.approx(s)


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(scores.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [pytest.approx(0.6), 0.0, 0.0, 0.0, 0.0]


def side(**k):
    base = {"fingerprint": "1", "front": "f", "key": None, "tokens": [], "trigrams": [], "backs": [], "vendor": None}
    kinds = {"tokens": "array<string>", "trigrams": "array<string>", "backs": "array<string>"}
    out = {}
    for n, v in (base | k).items():
        out[n] = F.array(*[F.lit(x) for x in v]).cast("array<string>") if n in kinds else F.lit(v).cast("string")
    return out


@pytest.mark.parametrize(
    "a, b, cos, score, reasons",
    [
        ({}, {}, None, 1.0, ["exact_fingerprint", "exact_front"]),
        ({}, {"fingerprint": "2"}, None, 0.98, ["exact_front"]),
        ({"front": ""}, {"front": "", "fingerprint": "2"}, None, 0.0, ["low_similarity"]),
        ({"key": "k"}, {"key": "k", "fingerprint": "2", "front": "g"}, None, 0.95, ["semantic_key_match"]),
        ({"tokens": ["a", "b", "c"]}, {"tokens": ["a", "b", "c"], "fingerprint": "2", "front": "g"}, 0.8, 0.98125, ["embedding_match", "token_overlap"]),
        ({"vendor": "x"}, {"vendor": "y", "fingerprint": "2", "front": "g"}, 0.97, 0.0, ["embedding_cross_vendor_ignored"]),
        ({}, {"fingerprint": "2", "front": "g"}, 0.93, 0.0, ["low_similarity"]),
        ({}, {"fingerprint": "2", "front": "g"}, 0.96, 0.99625, ["embedding_match"]),
    ],
)
def test_pair_score(spark, a, b, cos, score, reasons):
    s, r = scores.pair_score(side(**a), side(**b), None if cos is None else F.lit(cos))
    row = spark.range(1).select(s.alias("s"), r.alias("r")).first()
    assert row.s == pytest.approx(score) and row.r == reasons


@pytest.mark.parametrize(
    "front, back, want",
    [
        ("q", "", ["back_vacio"]),
        ("q", "word " * 80, ["respuesta_larga"]),
        ("q", "- one\n- two", ["no_atomica"]),
        ("q", "one. two. three", ["no_atomica"]),
        ("q", "Yes", ["reconocimiento"]),
        ("q", "yesterday", []),
        ("what is a container", "a container thing", ["pista_filtrada"]),
        ("q", "A clean answer", []),
    ],
)
def test_flags(spark, front, back, want):
    df = spark.createDataFrame([(front, back)], "f string, b string")
    got = df.select(quality.flags(F.col("b"), text.normal(F.col("b")), quality.words(F.col("f")), quality.words(F.col("b"))).alias("x")).first().x
    assert got == want


def test_cloze_and_better_version(spark):
    for back, want in (("dns", True), ("a b c d", True), ("a b c d e", False), ("no", False), ("a; b", False), ("", False)):
        assert one(spark, back, quality.suits_cloze) is want
    empty, long = F.array().cast("array<string>"), F.array(F.lit("respuesta_larga"))
    for new, old, a, b, want in ((empty, long, "x", "y", "replace_old_with_new"), (empty, empty, "much longer text", "short", "replace_old_with_new"), (long, long, "much longer text", "short", "keep_existing"), (empty, empty, "same", "same", "keep_existing")):
        assert spark.range(1).select(quality.better_version(new, old, F.lit(a), F.lit(b)).alias("x")).first().x == want


def test_confidence(spark):
    m = lambda **k: F.from_json(F.lit(__import__("json").dumps(k)), "map<string,string>")
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    for scope, good, bad, want in ((m(vendor="aws", topic="x"), a(), a(), "high"), (m(vendor="aws"), a("topic::x"), a("_unresolved::y"), "medium"), (m(), a("cert::y"), a(), "medium"), (m(), a(), a("_unresolved::y"), "low")):
        assert spark.range(1).select(quality.confidence([], scope, good, bad).alias("x")).first().x == want
