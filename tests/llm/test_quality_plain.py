"""The quality classifier against statistics by plain Python, a dense ridge and pooling until nothing is out of order."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import quality
from quillstone.sources.tables import table


def plain_statistics(text):
    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    if not words:
        return [0.0] * len(quality.STATISTICS)
    shares = [sum(c in set(members) for c in raw) / len(raw) for members in quality._CLASSES.values()]
    echo = sum(a == b for a, b in zip(words, words[1:]))
    return [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / len(words), *shares, len(set(words)) / len(words), echo / len(words), math.log1p(max(map(len, words)))]


def pooled(points):
    """Blocks (position, label sum, rows) merged wherever a mean isn't above the one before."""
    blocks = [list(p) for p in points]
    while True:
        at = next((i for i in range(len(blocks) - 1) if blocks[i][1] / blocks[i][2] >= blocks[i + 1][1] / blocks[i + 1][2]), None)
        if at is None:
            return blocks
        (p, y, n), (q, z, m) = blocks[at], blocks.pop(at + 1)
        blocks[at] = [(p * n + q * m) / (n + m), y + z, n + m]


def test_scores_are_those_of_a_plain_version(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in texts}
    apart = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(5)) == 0).collect()}
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}

    rows = np.stack([x[i] for i in known])
    scale = rows.std(0)
    model = quality.Classifier(rows.mean(0), scale)  # for its frequencies alone
    z = {i: np.append(np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((v - rows.mean(0)) / np.where(scale > 1e-9, scale, 1), -6, 6) @ model.frequency + model.phase), 1.0) for i, v in x.items()}
    learn = [i for i in known if i not in apart]
    a, y = np.stack([z[i] for i in learn]), np.array([float(known[i]) for i in learn])
    # ridge as least squares over the rows and one more row a weight
    weights = np.linalg.lstsq(np.vstack([a, math.sqrt(quality.RIDGE) * np.eye(a.shape[1])]), np.append(y, np.zeros(a.shape[1])), rcond=None)[0]
    raw = {i: float(v @ weights) for i, v in z.items()}
    bins = {}
    for i in known:
        if i in apart:
            r = min(max(raw[i], -0.5), 1.5)
            bins.setdefault(math.floor(r * quality.CALIBRATION_BINS), []).append((r, known[i]))
    blocks = pooled([(np.mean([r for r, _ in b]), sum(k for _, k in b), len(b)) for _, b in sorted(bins.items())])
    at, value = [b[0] for b in blocks], np.maximum.accumulate([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    want = {i: float(np.clip(np.interp(r, at, value), 0, 1)) for i, r in raw.items()}

    got = {r.doc_id: r.score for r in quality.score_quality(docs, docs, labels).collect()}
    assert got.keys() == want.keys() and len(apart & known.keys()) > 5 and len(learn) > 20
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6
