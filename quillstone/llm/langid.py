"""Language identification as mixture inference.

A document is a mixture of languages, each a distribution of byte trigrams.
Expectation-maximisation estimates the proportions; the set of languages is
the one of best likelihood less a penalty for each language beyond the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.plans.store import small_batches

#: Labelled documents that the trigram counts are taken from, about, whatever the corpus holds.
TRAIN_DOCS = 6000
BUCKET_BITS = 16
ROUNDS = 12
#: Log-likelihood that a further language must add, as a multiple of log(trigrams) / 2.
PENALTY = 8.0
SMOOTHING = 0.5
UNDETERMINED = "und"

#: ASCII letters in lower case and bytes beyond ASCII; all else is a gap.
_LETTERS = np.where(B.ALNUM[B.LOWER], B.LOWER, 0x20).astype(np.uint8)
_LETTERS[0x30:0x3A] = 0x20


def trigrams(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of a block, in order: text number, bucket and count."""
    buf = np.concatenate([np.array([0x20], np.uint8), _LETTERS[block.buf]])
    wide = buf.astype(np.uint32)
    code = (((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    gap = buf == 0x20
    use = ~(gap[1:-1] & (gap[:-2] | gap[2:]))
    text = np.repeat(np.arange(block.n, dtype=np.uint32), np.diff(block.at))[: len(code)]
    # the trigram that begins at a text's own end belongs to no text
    use &= np.arange(len(code)) < (block.at[1:] - 1)[text]
    key = np.sort(((text << np.uint32(BUCKET_BITS)) | code)[use])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint32(BUCKET_BITS)).astype(np.int64), (key & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int64), count


def has_letter(block: B.Block) -> np.ndarray:
    """Which texts hold a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = True
    out = np.add.reduceat(ascii_letter[block.buf], block.at[:-1], dtype=np.int64) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in block.buf[block.at[i] : block.at[i + 1] - 1].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """Trigram likelihoods of the learned languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        if self.languages:
            table = np.stack([counts[x] for x in self.languages], axis=1) + SMOOTHING
            p = table / table.sum(axis=0)
            # only ratios matter, so each row is scaled to a maximum of one
            self.p = (p / p.max(axis=1, keepdims=True)).astype(np.float32)
            self.log_p = np.log(self.p)

    def _em(self, p: np.ndarray, weight: np.ndarray, text: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts x languages) and log-likelihood, over the allowed languages of each text."""
        mix = allowed / allowed.sum(axis=1, keepdims=True)
        total = np.add.reduceat(weight, first)[:, None]
        for _ in range(ROUNDS):
            part = p * mix[text].astype(np.float32)
            part *= (weight / part.sum(axis=1))[:, None]
            mix = np.add.reduceat(part, first, axis=0) / total
        seen = (p * mix[text].astype(np.float32)).sum(axis=1)
        return mix, np.add.reduceat(weight * np.log(seen), first)

    def mixtures(self, block: B.Block) -> np.ndarray:
        """Proportions of the selected languages for each text (texts x languages); zeros if undetermined."""
        out = np.zeros((block.n, len(self.languages)))
        if not self.languages:
            return out
        text, bucket, count = trigrams(block)
        live, first = np.unique(text, return_index=True)
        known = has_letter(block)
        if len(live):
            weight = count.astype(np.float32)
            p = self.p[bucket]
            size = np.diff(np.append(first, len(text)))
            local = np.repeat(np.arange(len(live)), size)
            singles = np.add.reduceat(self.log_p[bucket] * weight[:, None], first, axis=0)
            best = singles.max(axis=1).astype(np.float64)
            chosen = np.eye(len(self.languages))[singles.argmax(axis=1)]
            if len(self.languages) > 1:
                full, bound = self._em(p, weight, local, first, np.ones((len(live), len(self.languages))))
                price = PENALTY * 0.5 * np.log(np.maximum(np.add.reduceat(weight, first), 2))
                rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
                for k in range(2, len(self.languages) + 1):
                    # no set of k can pass the likelihood of all languages together
                    open_ = np.flatnonzero(bound - price * (k - 1) > best)
                    if not len(open_):
                        break
                    rows = B.ragged(first[open_], size[open_])
                    at = np.cumsum(size[open_]) - size[open_]
                    mix, seen = self._em(p[rows], weight[rows], np.repeat(np.arange(len(open_)), size[open_]), at, (rank[open_] < k).astype(float))
                    better = seen - price[open_] * (k - 1) > best[open_]
                    chosen[open_[better]] = mix[better]
                    best[open_[better]] = (seen - price[open_] * (k - 1))[better]
            out[live] = chosen
        # a letter without trigram evidence: all languages alike, the first in order is named
        bare = known & (out.sum(axis=1) == 0)
        out[bare] = 1 / len(self.languages)
        out[~known] = 0
        return out


def train(labelled: DataFrame, lang_col: str, text_col: str) -> Model:
    """Counts over a bounded labelled sample, summed in a few tasks (languages x buckets each)."""

    def kernel(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for block in B.blocks(batch.column(1)):
                text, bucket, count = trigrams(block)
                for lang in set(langs[block.lo : block.hi]):
                    mine = np.array([x == lang for x in langs[block.lo : block.hi]])[text]
                    counts.setdefault(lang, np.zeros(1 << BUCKET_BITS))
                    counts[lang] += np.bincount(bucket[mine], count[mine], 1 << BUCKET_BITS)
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([c.astype("<f4").tobytes()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for row in labelled.select(lang_col, text_col).repartition(4).mapInArrow(kernel, "lang string, counts binary").toLocalIterator():
        total[row.lang] = total.get(row.lang, 0) + np.frombuffer(row.counts, "<f4").astype(np.float64)
    return Model(total)


def sample(rows: DataFrame, size: int, *id_cols: str) -> DataFrame:
    """About ``size`` rows, chosen by a hash of their ids; all, if there are no more."""
    n = rows.count()
    share = min(1.0, size / max(n, 1))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), *id_cols), F.lit(1_000_000)) < int(1_000_000 * share) + 1) if share < 1 else rows


def identify(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (its share of the text), ``mixture``.

    Trigram counts come from about ``train_docs`` rows of ``learn_from`` that
    have text and language.  A text that is null or without a letter is
    ``und`` with score 0, as is every text if nothing can be learned.  Equal
    shares go to the first language in order.  Repeated rows stay repeated,
    an empty table gives no rows, other columns are ignored.  A text of any
    length is taken whole, as a block of its own if it is beyond one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = learn_from.where(F.col(lang_col).isNotNull())
    model = train(sample(usable, train_docs, id_col).where(F.col(text_col).isNotNull()), lang_col, text_col)
    shared = spark.sparkContext.broadcast(model)

    def kernel(batches):
        model = shared.value
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                mix = model.mixtures(block)
                top = mix.argmax(axis=1) if mix.shape[1] else np.zeros(block.n, np.int64)
                share = mix[np.arange(block.n), top] if mix.shape[1] else np.zeros(block.n)
                names = [model.languages[t] if s > 0 else UNDETERMINED for t, s in zip(top.tolist(), share.tolist(), strict=True)]
                held = [[(model.languages[j], float(row[j])) for j in np.flatnonzero(row > 0)] for row in mix]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.n), pa.array(names, pa.string()), pa.array(np.clip(share, 0, 1)), pa.array(held, pa.map_(pa.string(), pa.float64()))],
                    names=["id", "lang_pred", "score", "mixture"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(kernel, f"id {kind}, lang_pred string, score double, mixture map<string,double>").withColumnRenamed("id", id_col)
