"""Whole queries on the smallest tables, row by row against plain versions."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from quillstone.llm import langid, pii
from quillstone.llm import queries as Q


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op8(spark, sf_dir, texts):
    prints = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hs = [xxhash.xxh64_intdigest(" ".join(words[s : s + 3]).encode(), 42) for s in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in Q.op8_simhash(spark, sf_dir).collect()}
    assert got == {(i, f"{prints[i]:016x}", find(i)) for i in texts}


def test_op9(spark, sf_dir, texts):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import base64

    with open(Q.vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, text in texts.items():
        ids = plain.encode_ordinary(text)
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(plain.decode_bytes(ids))))
    got = Q.op9_byte_bpe(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and all(r.exact for r in got)


def test_op5(spark, sf_dir, texts):
    """Base spans by the patterns themselves; what the method adds overlaps none of its own kind, and all of it is in order."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, s):
        n = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else False, "card": 13 <= len(n) <= 19 and pii.luhn(n), "phone": 9 <= len(n) <= 15}[kind]

    got = {r.doc_id: r for r in Q.op5_pii(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        base = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if valid(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in patterns] == [sum(x[0] == k for x in base) for k in patterns]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s)]
        assert set(base) <= set(spans) and all(0 <= a < b <= len(text) for _, a, b in spans)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))


def test_op1(spark, sf_dir, texts):
    """Mixtures by plain EM over every set of languages; the query must pick a language of a set that is no worse than the best found by it."""
    from itertools import combinations

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = langid.train(learn, "lang", "text")
    table = model.p.astype(float)
    got = {r.doc_id: r for r in Q.op1_language_id(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    import pyarrow as pa

    from quillstone.llm import _bytes as B

    agree = 0
    for i, text in texts.items():
        block = next(iter(B.blocks(pa.array([text]))))
        _, bucket, count = langid.trigrams(block)
        if not any(c.isalpha() for c in text):
            assert got[i].lang_pred == "und" and got[i].score == 0
            agree += 1
            continue
        best = None
        for k in range(1, len(model.languages) + 1):
            for chosen in combinations(range(len(model.languages)), k):
                p, mix = table[bucket][:, chosen], np.full(k, 1 / k)
                for _ in range(langid.ROUNDS if k > 1 else 0):
                    part = p * mix
                    mix = (part / part.sum(1, keepdims=True) * count[:, None]).sum(0) / count.sum()
                value = (count * np.log((p * mix).sum(1))).sum() - langid.PENALTY * 0.5 * np.log(max(count.sum(), 2)) * (k - 1)
                if best is None or value > best[0]:
                    best = (value, chosen, mix)
        _, chosen, mix = best
        agree += got[i].lang_pred == model.languages[chosen[int(np.argmax(mix))]] and abs(got[i].score - mix.max()) < 0.02
    assert agree >= 0.99 * len(texts)
