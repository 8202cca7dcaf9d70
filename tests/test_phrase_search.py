"""Phrase containment and case folding against plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillstone.functions.text import casefolded, folded_words, normalized_words
from quillstone.operators import phrase_search


def contains(words, phrase):
    return bool(phrase) and f" {' '.join(phrase)} " in f" {' '.join(words)} "


def test_whole_phrases_on_word_boundaries(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "dd", "é", "it's", "日"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)]
    docs += [(200, None), (None, "a b c dd"), (201, ""), (202, "ab cdd"), (0, "never elsewhere"), (203, "a " * 30_000 + "z end")]
    phrases = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))) for i in range(80)]
    phrases += [(300, None), (301, ""), (302, "absent word"), (None, "a"), (303, "a b"), (304, "a b"), (305, "never elsewhere"), (306, docs[3][1]), (307, "a " * 30_000 + "z end"), (308, "a z"), (309, "z end")]
    words = lambda t: re.findall(r"[^\W_]+(?:'[^\W_]+)?", (t or "").lower())
    want = {(p, d) for p, x in phrases for d, t in docs if p is not None and d is not None and contains(words(t), words(x))}
    left = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, w string").repartition(3)
    right = spark.createDataFrame([(i, t, 1) for i, t in phrases], "item_id bigint, text string, number int")
    for limit in (phrase_search.SHARD_WORDS, 20_000):
        got = phrase_search.contained_phrases(left, right, normalized_words(F.col("text")), normalized_words(F.col("text")), shard_words=limit)
        assert sorted((r.item_id, r.doc_id) for r in got.collect()) == sorted(want)
    for a, b in ((left.where("false"), right), (left, right.where("false"))):
        assert phrase_search.contained_phrases(a, b, normalized_words(F.col("text")), normalized_words(F.col("text"))).count() == 0


def test_plan_has_no_nested_loop(spark, sf_dir):
    from quillstone import catalog

    plan = catalog.QUERIES["F08_phrase_containment"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_folding_as_python(spark):
    # characters that the JVM's Unicode and Python's both know
    texts = ["Straße STRASSE ẞ", "ΌΔΟΣ ὀδός Σ", "ﬁn ﬀ ŉ ǰ", "İstanbul ı", "Éa_1 ²½ ⅷ", "µ ſ ϐ", "ᏣᎳᎩ", "áb", "日本_語", None, "", "x-y'z"]
    texts += ["".join(c for c in map(chr, range(lo, lo + 64)) if unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Cs")) for lo in range(0x41, 0x2100, 61)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in docs.select("i", casefolded(F.col("text")).alias("f"), folded_words(F.col("text")).alias("w")).collect():
        text = texts[r.i]
        assert r.f == (None if text is None else text.casefold())
        assert r.w == (None if text is None else re.findall(r"\w+", text.casefold()))
