"""Operators on small tables: nulls, empty tables, repeats, ties, clashing columns, and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, chat, langid, media, pii, quality, recompress, simhash, url_filter, winnow

LONG = " ".join(f"w{i % 97}" for i in range(6000))
DOCS = [(1, "the quick brown fox"), (2, None), (3, ""), (None, "a text without id"), (4, "the quick brown fox"), (4, "the quick brown fox"), (5, LONG), (6, "  \n\t "), (7, "mail me.now@mail.example.com or +1 (555) 010-2200 é 10.0.0.1")]


@pytest.fixture(scope="module")
def docs(spark):
    # columns named as those that operators make
    schema = "doc_id bigint, text string, score double, id string, fp bigint, items string, key string"
    return spark.createDataFrame([(i, t, 0.5, "x", 1, "y", "z") for i, t in DOCS], schema)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_every_operator_takes_every_row(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    vocabulary = public.path("byte_bpe_50k.tiktoken")
    bench = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (None, "the"), (2, None), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (7, 1), (None, 1), (9, None)], "doc_id bigint, quality int")
    learn = docs.withColumn("lang", F.when(F.col("doc_id") > 1, "en"))
    runs = {
        "simhash": lambda d: simhash.simhash_components(d),
        "winnow": lambda d: winnow.decontaminate(d, bench),
        "pii": lambda d: pii.find_pii(d),
        "redact": lambda d: pii.redact_pii(d),
        "bpe": lambda d: bpe.round_trip(d, vocabulary),
        "encode": lambda d: bpe.encode(d, vocabulary),
        "substrings": lambda d: recompress.dedup_substrings(d),
        "quality": lambda d: quality.score_quality(d, docs, labels),
        "languages": lambda d: langid.identify(d, learn),
    }
    for name, run in runs.items():
        assert run(docs).count() == len(DOCS), name
        assert run(empty).count() == 0, name
    for name, run in {"winnow": lambda: winnow.decontaminate(docs, bench.where("false")), "quality": lambda: quality.score_quality(docs, docs, labels.where("false")), "languages": lambda: langid.identify(docs, learn.where("false"))}.items():
        assert run().count() == len(DOCS), name
    none = langid.identify(docs, learn.where("false")).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_components_equal_brute_force(spark, monkeypatch):
    rng = random.Random(0)
    centre = rng.getrandbits(64)
    prints = {0, 1, 7, (1 << 63), centre}
    for _ in range(300):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    from quillstone.operators.components import connected_components

    for dense in (64, 4):  # without and with the ties of crowded halves
        monkeypatch.setattr(simhash, "DENSE", dense)
        fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
        roots = {r.node: r.root for r in connected_components(simhash.links(fps)).collect()}
        assert {x: roots.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_substrings_equal_brute_force(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(64)]
    rows = []
    for i in range(40):
        words = rng.choices([f"v{j}" for j in range(200)] if i % 3 else ["a", "b"], k=rng.randint(0, 140))
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[: rng.choice([49, 50, 60, 64])] * rng.choice([1, 2])
        rows.append((i, "  ".join(words)))
    rows += [(50, rows[4][1]), (51, rows[8][1] + " tail"), (52, " ".join(["a"] * 90)), (53, " ".join(["a"] * 130)), (54, None), (None, rows[4][1])]
    order = rows[:]
    rng.shuffle(order)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in recompress.dedup_substrings(spark.createDataFrame(order, "doc_id bigint, text string")).collect()}
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = set()
    for i, t in rows:
        w = (t or "").split()
        gone = {s + k for s in range(len(w) - 49) if i is not None and first[tuple(w[s : s + 50])] < i for k in range(50)}
        want.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == want


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = "a B c d".split()
    items = [" ".join(rng.choices(vocab, k=n)) for n in (1, 3, 7, 9, 10, 11, 25, 25)] + ["", None]
    rows = list(enumerate(items)) + [(7, items[7]), (50, items[7]), (None, "a")]
    docs = [(i, "-".join(rng.choices(vocab, k=rng.randint(0, 60))), "x") for i in range(60)] + [(70, items[7] + " x " + items[2], "y"), (70, "q", "z"), (71, None, "y"), (None, items[6], None), (72, "é ü", "y"), (72, "é ü", "y")]
    want = []
    for i, text, lang in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        hit, found = set(), set()
        for j, item in rows:
            v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
            n = min(10, len(v))
            wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n and j is not None else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found.add(str(j))
        want.append((i, lang, len(w), len(hit), sorted(found)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    got = winnow.decontaminate(df, spark.createDataFrame(rows, "item_id bigint, text string"), keep=("lang",)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.lang, r.n_words, r.n_hit, r["items"])) for r in got)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)


def test_redaction_takes_the_spans_out(spark, docs):
    texts = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
    assert texts[7] == "mail <EMAIL> or <PHONE> é <IP>" and texts[2] is None and texts[1] == "the quick brown fox"


def test_chat_windows(spark):
    turns = []
    for conv in range(12):
        rng = random.Random(conv)
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0, 9)
        turns += [(conv, i, role, rng.choice(["hi", "x" * rng.randint(0, 900), "<|im_end|>\\", "a\\<|b\n", None])) for i, role in enumerate(roles)]
    turns += [(99, 0, "odd\nrole<|", "t"), (99, 0, "odd\nrole<|", "t"), (99, None, None, None), (None, 1, "assistant", "lost")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("win", F.lit("clash")).withColumn("n", F.lit(1))
    windows = chat.format_conversations(df)
    assert chat.format_conversations(df.where("false")).count() == 0
    rows = windows.orderBy("conv_id", "win").collect()
    control = [r.formatted.count(chat.START) for r in rows]
    assert control == [r.n_turns for r in rows] and [r.formatted.count(chat.END) for r in rows] == control
    back = {}
    for r in chat.read_back(windows).orderBy("conv_id", "win").collect():
        held = back.setdefault(r.conv_id, ([], []))
        held[0].extend((t.role, t.text) for t in r.turns)
        held[1].extend(r.loss_texts)
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert back[conv][0] == [(t[2] or "", t[3] or "") for t in own]
        assert back[conv][1] == [t[3] or "" for t in own if t[2] == "assistant"]
    size = lambda r: len(r.formatted)
    assert all(not r.over_budget or size(r) > 0 for r in rows)


def test_queries_of_urls_count_but_for_tracking(spark):
    urls = ["http://a.org/p?id=1&page=2", "https://www.a.org/p/?page=2&utm_source=x&id=1#top", "http://a.org/p?page=2&&id=1&ref", "http://a.org/p?id=1", "http://a.org/p", "http://a.org/p?gclid=7", "http://a.org/p?reference=1", "http://a.org/p#?id=1&page=2", "http://a.org?id=1&page=2/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    blocked = lambda listed: {r.page_id for r in url_filter.judge_urls(pages, rules, spark.createDataFrame([(listed,)], "url string")).where("verdict = 'block'").collect()}
    assert blocked(urls[1]) == {0, 1, 2} and blocked("http://a.org/p?utm_id=3") == {4, 5, 7}


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/", "http://example.com/fr/", "http://example.com", "http://x.net/es/1#f", "http://x.net/es", "http://badcom/", "noscheme", None, "", "http://spam.org/a", "http://spam.org/a", "://h.net/fr/z", "http://a.b.c.d.e.f/g", "ftp://spam.org/a//#x", "http://spam.org/ab", "http://sub.spam.org/a", "http://" + "l" * 5000 + ".org/" + "p" * 50_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("key", F.lit("clash")).withColumn("host", F.lit("old"))
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://www.SPAM.org:443/a/index.html?x",), ("http://spam.org/a",), (None,), ("noscheme",), ("http:///",), ("http://" + "l" * 5000 + ".org/" + "p" * 50_000,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, listed).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3] == ("example.com", "", None, "allow") and got[4][2:] == ("net/es/", "block") and got[5][2:] == (None, "allow") and got[6][2:] == (None, "allow")
    assert all(got[i] == ("", "", None, "allow") for i in (7, 8, 9)) and got[10][2:] == got[11][2:] == (None, "block") and got[12] == ("h.net", "/fr/z", "net/fr/", "block")
    assert [got[i][3] for i in (14, 15, 16, 17)] == ["block", "allow", "allow", "block"]
    assert url_filter.judge_urls(pages.where("false"), rules, listed).count() == 0
    assert url_filter.judge_urls(pages, rules.where("false"), listed.where("false")).where("verdict = 'block'").count() == 0


def test_image_copies(spark):
    rng = np.random.default_rng(5)
    images = [media.encode_pgm(np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))) for _ in range(12)]
    crops = [media.encode_pgm(media.decode_image(im)[5:60, 3:58] * 0.9 + 10) for im in images[:4]]
    table = [(i, im) for i, im in enumerate(images)] + [(20, images[0]), (20, images[0]), (21, None), (22, b"junk")]
    df = spark.createDataFrame(table, "id bigint, image binary").withColumn("sketch", F.lit("clash"))
    classes, found = media.find_copies(df, spark.createDataFrame(list(enumerate(crops)), "id bigint, image binary"))
    by = {r.id: r.class_id for r in classes.collect()}
    assert classes.count() == len(table) and by[20] == 0 and by[3] == 3 and by[21] is None and by[22] is None
    assert {(r["query"], r["class_id"]) for r in found.collect()} == {(i, i) for i in range(4)}
    none, nothing = media.find_copies(df.where("false"), df.where("false"))
    assert none.count() == nothing.count() == 0


def test_held_out_accuracy(spark, sf_dir):
    from quillstone.llm.queries import QUERIES

    big = sf_dir.replace("sf0.001", "sf0.01")
    langs = QUERIES["op1_language_id"](spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    good = QUERIES["op6_quality"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    assert good.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_pipeline_equals_a_plain_version(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = corpus_pipeline.quality_classifier(spark, docs, sf_dir)
    kept = {r.doc_id: r.text for r in scored.collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in kept.items()}
    sets = {i: frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset() for i, w in words.items()}
    parent = {i: i for i in kept}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and (not either or both / either >= 0.8):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[s : s + 10]) for w in items for s in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = set()
    for i in ids:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), kept[i]))
        if find(i) == i and not any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1)):
            clean.add(i)
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == clean and out.where("not exact").count() == 0
    texts = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs.where(F.col("doc_id").isin(sorted(clean))), sf_dir).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(out, corpus_pipeline.vocabulary()).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in back.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_pipeline_stages_take_every_row(spark, sf_dir):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double, items string"
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", 0.1, "y") for i, t in DOCS], schema)
    n = {name: f(spark, docs, sf_dir) for name, f in corpus_pipeline.STAGES}
    for (name, f), columns in zip(corpus_pipeline.STAGES, [corpus_pipeline.COLUMNS] * 4 + [["doc_id", "ids", "n_tokens", "decoded_sha256", "exact"]]):
        assert n[name].columns == columns and f(spark, docs.where("false"), sf_dir).count() == 0, name
    # ids 2, 3 and 6 have no words, 4 is a copy of 1, and one row of 4 repeats the other
    assert sorted(r.doc_id or 0 for r in n["near-dedup by shingles"].collect()) == [0, 1, 2, 5, 7]
    assert n["benchmark decontamination"].count() == n["personal data"].count() == n["byte-level BPE"].count() == len(DOCS)
    assert n["byte-level BPE"].where("exact").count() == len(DOCS)
