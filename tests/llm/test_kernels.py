"""Kernels against plain Python: no Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillstone.llm import _bytes as B
from quillstone.llm import bpe, langid, media, pii, quality, recompress, simhash, url_filter, winnow

TEXTS = ["", None, "a", "A b", "The  quick\tBrown fox\n jumps", "é" * 40 + " ü ß", "x " * 700, "word" * 5000, " lead and trail ", "日本語 テスト 文", "𝒳 🙂 ok"]


def blocks(texts, **more):
    return list(B.blocks(pa.array(texts, pa.string()), **more))


def test_blocks_hold_every_text_once():
    for limit in (1, 10, 1000, 1 << 20):
        got = [b.buf[b.at[i] : b.at[i + 1] - 1].tobytes().decode() for b in blocks(TEXTS, limit=limit) for i in range(b.n)]
        assert got == [t or "" for t in TEXTS]
    assert blocks([]) == []
    sliced = pa.array(["skip", *TEXTS], pa.string()).slice(1)
    assert sum(b.n for b in B.blocks(sliced)) == len(TEXTS)


def test_words_and_xxh64():
    for b in blocks(TEXTS):
        w = B.Words(b, B.SPACED, lower=True)
        raw = w.buf.tobytes()
        for i in range(b.n):
            text = re.sub("[A-Z]", lambda m: m[0].lower(), TEXTS[b.lo + i] or "")
            want = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
            assert [raw[s:e] for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] == want
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 600)
    end = start + rng.integers(0, 90, 600)
    want = [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(start, end)]
    assert B.xxh64_spans(buf, start, end).tolist() == want


def test_simhash_equals_counting_bits():
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    texts = [*TEXTS, "a b", "a b c", " ".join(map(str, range(1200)))]
    got = np.concatenate([simhash.fingerprints(b) for b in blocks(texts)]).tolist()
    assert got == [plain(t) for t in texts]


def test_fingerprints_are_the_least_hashes_of_windows():
    rng = np.random.default_rng(3)
    for size in (1, 4, 5, 9, 10):
        names = rng.integers(0, 7, 60).astype(np.uint64)
        text = np.sort(rng.integers(0, 4, 60))
        at, marks = winnow.fingerprints(names, text, size)
        k = min(winnow.GRAM, size)
        whole = [s for s in range(60 - size + 1) if text[s] == text[s + size - 1]]
        assert at.tolist() == whole
        assert marks.tolist() == [min(B.span_hashes(names, np.arange(s, s + size - k + 1), k).tolist()) for s in whole]


def test_base_spans_equal_the_patterns():
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def valid(kind, s):
        n = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(n) <= 19 and pii.luhn(n), "phone": lambda: 9 <= len(n) <= 15}[kind]()

    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a.@1-+ (9)%4é") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == [(k, *m.span()) for k, p in patterns for m in re.finditer(p, text) if valid(k, m[0])]
    # linear in the text, whatever it holds
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000) == [] and pii.base_spans("a@" * 100_000) == []


def test_field_learns_its_table_and_viterbi_is_exact():
    field = pii.Field()
    for line in pii.LABELLED:
        code, tags = pii._labelled(line)
        starts = np.zeros(len(code), bool)
        starts[0] = True
        assert field.decode(field.scores(code, starts), starts).tolist() == tags
    rng = np.random.default_rng(1)
    for _ in range(20):
        score = rng.normal(0, 3, (200, 6))
        score[:, 0] += rng.choice([0, 2, 30], 200)
        starts = rng.random(200) < 0.1
        starts[0] = True
        want = []
        cuts = [*np.flatnonzero(starts), 200]
        for a, b in zip(cuts, cuts[1:]):
            best, trail = score[a].copy(), []
            for t in range(a + 1, b):
                through = best[:, None] + field.trans
                trail.append(through.argmax(0))
                best = through.max(0) + score[t]
            path = [int(best.argmax())]
            for back in trail[::-1]:
                path.append(int(back[path[-1]]))
            want += path[::-1]
        assert field.decode(score, starts).tolist() == want


def test_bpe_equals_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    codec = bpe.Codec(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")))
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    letters = "  \n\t'''stredmlvl LDabc12½²٣ \x1c\x85.,!é漢字🙂áªǅ\r​　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["'s 're''ll 'sx", "<|endoftext|>", "a" * 2000, *[t or "" for t in TEXTS]]
    got = []
    for b in blocks(texts):
        ids, first = codec.encode(b)
        text, at = codec.decode(ids, first)
        assert all(text[at[i] : at[i + 1]].tobytes() == texts[b.lo + i].encode() for i in range(b.n))
        got += [ids[a:c].tolist() for a, c in zip(first[:-1], first[1:])]
    assert got == [plain.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal():
    values = B.mix64(np.arange(5000, dtype=np.uint64))
    table = bpe.PerfectHash(values)
    assert table(values).tolist() == list(range(5000)) and sorted(table.item.tolist()) == list(range(5000))


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(4)
    for vocab in (["a"], ["a", "b"], [f"w{i}" for i in range(30)]):
        docs = [" ".join(rng.choices(vocab, k=rng.randint(50, 160))) for _ in range(6)]
        part = docs[0].split()[:70]
        docs += [" ".join(["x", *part, "y"]), " ".join([*part, "z"]), " ".join(["q"] * 3 + part)]
        seen = {}
        for b in blocks(docs):
            w = B.Words(b, B.SPACED)
            start, anchor, _ = recompress.anchors(w.hashes(), w.text_of())
            raw = w.buf.tobytes()
            for s, a in zip(start.tolist(), anchor.tolist()):
                window = tuple(raw[w.start[s + i] : w.end[s + i]] for i in range(50))
                assert seen.setdefault(window, a) == a


def test_statistics_and_isotonic():
    x = np.concatenate([quality.statistics(b) for b in blocks(TEXTS)])
    assert x.shape == (len(TEXTS), len(quality.STATISTICS)) and np.isfinite(x).all() and not x[0].any() and not x[1].any()
    at, value = quality.pool_adjacent(np.arange(6.0), np.array([0, 5, 0, 9, 9, 10.0]), np.full(6, 10.0))
    assert (np.diff(value) >= 0).all() and len(at) == len(value)


def test_languages_of_a_mixed_text():
    english, german = "the cat sat on the mat and the dog ran with the ball", "der hund lief mit dem ball und die katze schlief auf der decke"
    counts = {}
    for lang, text in (("en", english), ("de", german)):
        counts[lang] = np.zeros(1 << langid.BUCKET_BITS)
        for b in blocks([text * 5]):
            _, bucket, n = langid.trigrams(b)
            np.add.at(counts[lang], bucket, n)
    model = langid.Model(counts)
    b = blocks([english, german, " ".join([english] * 6 + [german] * 6), "", None, "123 !!"])[0]
    mix = model.mixtures(b)
    assert mix[0].tolist() == [0, 1] and mix[1].tolist() == [1, 0] and (mix[2] > 0.25).all() and not mix[3:].any()


def test_url_filter_bits():
    rng = np.random.default_rng(4)
    inside, outside = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    blocks_ = url_filter.filter_blocks(len(inside))
    bits = np.zeros(blocks_ * url_filter.BLOCK_BITS // 8, np.uint8)
    at = url_filter.bit_places(inside, blocks_).ravel()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    test = lambda h: ((bits[url_filter.bit_places(h, blocks_) >> 3] >> (url_filter.bit_places(h, blocks_) & 7).astype(np.uint8)) & 1).all(axis=1)
    assert test(inside).all() and test(outside).mean() < 0.02


def test_images():
    rng = np.random.default_rng(0)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))
    assert (media.decode_image(media.encode_pgm(image)) == image).all()
    assert media.decode_image(None) is None and media.decode_image(b"") is None and media.decode_image(b"P5 9 9 255\nx") is None
    crop = image[4:58, 6:60] * 0.85 + 15 + rng.normal(0, 3, (54, 54))
    other = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))
    a, b, c = (media.describe(x) for x in (image, crop, other))
    assert media.agreeing(*b, *a) >= media.LEAST_AGREEING > media.agreeing(*b, *c)
    assert set(media.sketch(*a)) & set(media.sketch(*b)) and not set(media.sketch(*a)) & set(media.sketch(*c))
    flat = media.describe(np.full((64, 64), 9.0))
    assert len(flat[0]) == 0 and media.sketch(*flat) == [] and media.agreeing(*flat, *a) == 0


def test_png_is_read():
    import zlib

    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (9, 7)).astype(np.uint8)
    left = np.diff(grey.astype(int), axis=1, prepend=0).astype(np.uint8)
    rows = b"".join([b"\0" + grey[y].tobytes(), b"\2" + (grey[y].astype(int) - grey[y - 1]).astype(np.uint8).tobytes(), b"\1" + left[y].tobytes()][y % 3] for y in range(9))

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    head = (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (media.decode_image(raw) == grey).all()
