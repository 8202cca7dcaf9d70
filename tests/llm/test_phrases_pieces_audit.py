"""Piece encoding, phrase mining and the filter audit against the library and plain versions; nulls, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.llm import filter_audit, phrases, pieces
from quillstone.llm import queries as Q

#: A text beyond one block, without spaces for long stretches.
LONG = "ab" * 400_000 + " " + "the quick brown fox. " * 20_000
ROWS = [(1, "the quick brown fox, the quick brown fox"), (2, None), (3, ""), (None, "a text without id"), (4, "A$ text"), (4, "A$ text"), (5, "  \n\t▁ é日\x00"), (6, LONG), (7, "A$ text"), (None, "a text without id")]


@pytest.fixture(scope="module")
def docs(spark):
    # columns named as those that operators make
    schema = "doc_id bigint, text string, lang string, part string, phrase string, n bigint, doc string, digest string, mask int, good int, id string, w string, `to` int"
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", "x", "y", 1, "z", "d", 3, 1, "i", "w", 2) for k, (i, t) in enumerate(ROWS)], schema)


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    return sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())


@pytest.fixture(scope="module")
def model(library):
    return pieces.Pieces(pieces.read_model(Q.piece_model()))


def _encoded(model, texts):
    out = []
    for block in B.blocks(pa.array(texts)):
        ids, where = model.framed(*model.encode(block))
        out += [ids[a:b].tolist() for a, b in zip(where, where[1:], strict=False)]
    return out


def test_pieces_as_the_library(model, library):
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\t", "\n", "é", "▁", "▁▁", "日", "本", "𝄞", "\x00", "​", "the ", "ing", " th", "e", "1", "<s>", "<0x41>", "ﷺ", "'", "==", "====", "aaaa"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x370, 0x1200), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 999, "=" * 777]
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert _encoded(model, texts) == want
    lists = want + [[rng.choice([rng.randint(0, 300), rng.randint(0, 31999), 259]) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    got = model.decode(np.array([i for x in lists for i in x]), np.cumsum([0, *map(len, lists)]))
    assert [t.decode() for t in got] == [library.decode(x) for x in lists]


def test_pair_compatibility_is_merging_both(model):
    rng = random.Random(2)
    blanks = [t for t in model.whole if set(model.text[t]) == {"▁"}]
    for _ in range(6000):
        a, b = (rng.choice(blanks if rng.random() < 0.1 else model.whole) for _ in range(2))
        assert model.compatible(a, b) == (model.merge(model.text[a] + model.text[b]) == [a, b])


def test_op11_rows(spark, docs, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text in ROWS:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        back = library.decode(ids)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode()), back == (text or "")))
    got = pieces.round_trip(docs, Q.piece_model()).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pieces.round_trip(docs.where("false"), Q.piece_model()).count() == 0
    back = pieces.decode(pieces.encode(docs, Q.piece_model()), Q.piece_model()).collect()
    assert Counter(sha((r.text or "").encode()) for r in back) == Counter(w[3] for w in want)


def test_op11_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op11_sentencepiece(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_models_of_other_kinds_are_refused(tmp_path):
    with pytest.raises(ValueError, match="not of the merge type"):
        pieces.Model(b"")


def _plain_phrases(rows, least, longest, cover, top):
    """Everything counted in dictionaries."""
    out = []
    for part in {p for p, _ in rows}:
        f, n = Counter(), 0
        for p, text in rows:
            if p != part:
                continue
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                w = re.findall("[^\x20\x09]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        chosen = {c: a for c, a in f.items() if len(c) > 1 and a >= least}
        kept = []
        for c, a in chosen.items():
            score, k = min((1000000 * a * a // (f[c[:k]] * f[c[k:]]), k) for k in range(1, len(c)))
            inside = any(len(d) > len(c) and 100 * b >= cover * a and any(d[i : i + len(c)] == c for i in range(len(d))) for d, b in chosen.items())
            if not inside:
                kept.append((-score, -a, " ".join(c).encode(), f[c[:k]], f[c[k:]]))
        out += [(part, i + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("longest", "cover", "top"), [(3, 50, 40), (5, 50, None), (2, 50, 7), (4, 100, 1000)])
def test_phrases_as_counting_everything(spark, longest, cover, top):
    rng = random.Random(longest)
    words = ["a", "b", "a\x01", "cc", "é", "日", "x" * 300]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 25)))
        rows.append((rng.choice(["", "en", "de"]), rng.choice([text.upper(), text, None if i % 50 == 0 else text + " b a cc é b"])))
    docs = spark.createDataFrame([(p or None, t) for p, t in rows], "lang string, text string").repartition(5)
    got = phrases.mine(docs, F.col("lang"), 4, longest, cover, top)
    assert sorted(map(tuple, got.collect())) == _plain_phrases(rows, 4, longest, cover, top or 10**9)


def test_phrases_of_every_kind_of_row(spark, docs):
    got = sorted(map(tuple, phrases.mine(docs, F.coalesce("lang", F.lit("und")), least=2, top=50).collect()))
    assert got == _plain_phrases([("und" if k % 3 == 0 else "en", t) for k, (_, t) in enumerate(ROWS)], 2, 3, 50, 50)
    assert phrases.mine(docs.where("false"), F.col("lang")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 4_000_000_000_123, 5_000_000_000_007, 6_000_000_000_011
    got = spark.sql(f"SELECT {phrases._score('a', 'l', 'r')} AS s FROM (SELECT {a}L AS a, {left}L AS l, {right}L AS r)").first().s
    assert got == 1000000 * a * a // (left * right)


def test_audit_as_running_every_order(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, None), (6, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    good, toxic = {1, 4, 6}, {4, 6}
    rows = []
    for k, (i, t) in enumerate(ROWS):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u in ROWS)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        rows.append(("" if k % 3 == 0 else "en", i, {f for f, x in fails.items() if x}))
    want = []
    for part in ("", "en"):
        own = [(i, fails) for p, i, fails in rows if p == part]
        of_part, total = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                of_part.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
        want += [(*x[:-1], total[x[-1]]) for x in of_part]
    got = filter_audit.audit_filters(docs, labels, F.col("lang"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert filter_audit.audit_filters(docs.where("false"), labels, F.col("lang")).count() == 0
    assert filter_audit.audit_filters(docs, labels.where("false"), F.col("lang")).agg(F.sum("good_lost")).first()[0] == 0
    own = filter_audit.audit_filters(docs, labels, F.lit("all"), {"x": F.col("doc_id") > 3}, None).collect()
    assert [(r.filter_order, r.removed, r.shapley, r.kept) for r in own] == [("x", 5, 5, 5)]
    with pytest.raises(ValueError, match="one letter"):
        filter_audit.audit_filters(docs, labels, F.col("lang"), same_text="A")


@pytest.mark.parametrize("period", [1, 2, 3, 7, 24, 25])
def test_a_repetition_is_one_anchor(period):
    from quillstone.llm import recompress

    rng = np.random.default_rng(period)
    unlike = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    names = np.resize(unlike[:period], 20_000)
    _, anchor, place = recompress.anchors(names, np.zeros(20_000, np.int64))
    assert len(np.unique(place)) == 1 and len(np.unique(anchor)) == 1
    # of another phase and length, beside other words, by the same name; only windows across its ends stand for themselves
    other = np.concatenate([unlike[100:160], names[1:91], unlike[200:260]])
    start, again, place = recompress.anchors(other, np.zeros(len(other), np.int64))
    assert set(again[(start >= 60) & (start <= 100)]) == set(anchor) and len(np.unique(place)) < 60
    # texts side by side stay apart
    text = np.repeat([0, 1], 10_000)
    start, _, place = recompress.anchors(names, text)
    assert all(len(set(text[start[place == p]])) == 1 for p in np.unique(place))


def test_repetitions_are_removed_as_by_comparing_windows(spark):
    from quillstone.llm import recompress

    rng = random.Random(9)
    docs = [(i, " ".join((rng.choices("abc", k=p) * 60)[rng.randint(0, 3) : rng.randint(40, 130)] + rng.choices("xyz", k=rng.randint(0, 60)))) for i, p in enumerate([1, 2, 3, 1, 2, 3, 7, 2, 1, 5, 3, 2, 1, 25, 2, 3])]
    docs += [(100 + i, "a " * 50) for i in range(4)] + [(200, "b a " * 40), (201, "a b " * 30)]
    first = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = []
    for i, t in docs:
        w = t.split()
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = recompress.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1))
    assert sorted(map(tuple, got.collect())) == sorted(want)
