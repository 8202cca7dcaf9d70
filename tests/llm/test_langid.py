"""Mixtures of many languages."""

import random

import numpy as np
import pyarrow as pa

from quillstone.llm import _bytes as B
from quillstone.llm import langid


def _text(letters, rng, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n))


def test_six_languages_in_one_text():
    rng = random.Random(1)
    letters = {f"l{i}": "abcdefghijklmnopqrstuvwx"[4 * i : 4 * i + 4] for i in range(6)}
    counts = {}
    for name, own in letters.items():
        (block,) = B.blocks(pa.array([_text(own, rng, 3000)]))
        _, bucket, count = langid.trigrams(block)
        counts[name] = np.bincount(bucket, count, 1 << langid.BUCKET_BITS)
    (block,) = B.blocks(pa.array([" ".join(_text(own, rng, 100) for own in letters.values()), _text(letters["l3"], rng, 100)]))
    mix = langid.Model(counts).mixtures(block)
    assert (mix[0] > 0.1).all() and (mix[1] > 0).tolist() == [i == 3 for i in range(6)]
