"""Words that weak hashes take for equal stay apart: op3, op4 and op9 on Thue-Morse words."""

import pytest

from quillstone.llm import bpe, recompress, winnow


def _pair(size):
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def rows(spark):
    one, other = _pair(2048)
    common = [f"w{i}" for i in range(49)]
    texts = [" ".join([*common[:20], one, *common[20:]]), " ".join([*common[:20], other, *common[20:]]), f"{one} {other}", " ".join([one, other] * 700), " ".join([other, one] * 700)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_substrings(rows):
    got = {r.doc_id: r.n_removed for r in recompress.dedup_substrings(rows).collect()}
    # windows of 50 alternating words start with either in document 3, so all of document 4 goes
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1400}


def test_word_sequences_that_mirror_each_other(spark):
    one, other = _pair(2048)
    texts = [" ".join(one), " ".join(other)]
    first = {tuple(one[s : s + 50]) for s in range(len(one) - 49)}
    gone = {s + k for s in range(len(other) - 49) if tuple(other[s : s + 50]) in first for k in range(50)}
    got = {r.doc_id: r.n_removed for r in recompress.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: 0, 1: len(gone)}


def test_benchmark_items(spark, rows):
    one, other = _pair(2048)
    items = spark.createDataFrame([(1, one), (2, f"{other} {one}")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in winnow.decontaminate(rows, items).collect()}
    assert got == {0: (1, ["1"]), 1: (0, []), 2: (1, ["1"]), 3: (1399, ["1", "2"]), 4: (1400, ["1", "2"])}


def test_bytes_come_back(rows):
    public = pytest.importorskip("public_tokenizers")
    out = bpe.round_trip(rows, public.path("byte_bpe_50k.tiktoken")).collect()
    assert len(out) == 5 and all(r.exact for r in out)
