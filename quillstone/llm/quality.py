"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and sent through cosines at random
frequencies, whose inner products approximate a Gaussian kernel.  Each task
sums the normal equations of its rows; the sums fit the ridge scores, which
a monotone step function, fitted on rows kept apart, turns into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.llm.langid import sample
from quillstone.plans.store import small_batches, written

#: Labelled documents used, about, whatever the corpus holds; a fifth of them calibrate.
TRAIN_DOCS = 12_000
FEATURES, RIDGE, SEED, WIDTH = 256, 1e-3, 7, 3.0
CALIBRATION_BINS = 1000

#: Byte classes whose shares are statistics.
_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "stop": b".,;:?'\"-()",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~",
    "line": b"\n",
    "wide": range(0x80, 0x100),
}
STATISTICS = ["log_bytes", "log_words", "word_bytes", *_CLASSES, "distinct", "echo", "longest"]


def statistics(block: B.Block) -> np.ndarray:
    """(texts x STATISTICS) of a block; all zero for a text without words."""
    size = np.maximum(np.diff(block.at) - 1, 0)
    words = B.Words(block, B.SPACED, lower=True)
    count = np.diff(words.first)
    text, names = words.text_of(), words.hashes() if len(words) else np.zeros(0, np.uint64)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    columns = [np.log1p(size), np.log1p(count), size / per_word]
    for members in _CLASSES.values():
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        columns.append(np.add.reduceat(table[block.buf], block.at[:-1], dtype=np.int64) / per_byte)
    keyed = np.unique(B.mix64(names ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    columns.append(np.bincount(text[keyed], minlength=block.n) / per_word)
    echo = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
    columns.append(np.bincount(text[1:][echo], minlength=block.n) / per_word)
    longest = np.zeros(block.n)
    np.maximum.at(longest, text, (words.end - words.start).astype(float))
    columns.append(np.log1p(longest))
    out = np.stack(columns, axis=1).astype(np.float64)
    out[count == 0] = 0
    return out


class Classifier:
    """Standardisation, frequencies, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.frequency = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def pool_adjacent(position: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of positive / total along ``position``: centres and values of the pooled blocks."""
    blocks: list[list[float]] = []
    for p, y, n in zip(position.tolist(), positive.tolist(), total.tolist(), strict=True):
        blocks.append([p * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # one half row of either label keeps blocks of few rows from certainty
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate(np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks]))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int) -> Classifier:
    spark = docs.sparkSession
    wide = len(STATISTICS)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = sample(marked, train_docs, id_col).groupBy(id_col).agg(F.round(F.avg(label_col)).cast("int").alias("label"))

    def kernel(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                x = statistics(block)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, wide, dtype=np.int32)), pa.array(x.ravel()))
                labels = batch.column(0).slice(block.lo, block.n)
                apart = batch.column(2).slice(block.lo, block.n)
                yield pa.RecordBatch.from_arrays([labels, apart, lists], names=["label", "apart", "x"])

    # the sample is bounded by train_docs, so it is broadcast to the scan of the texts
    rows = docs.join(F.broadcast(chosen), id_col).select("label", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.pmod(F.xxhash64(F.lit("apart"), id_col), F.lit(5)) == 0).alias("apart"))
    rows = written(rows.mapInArrow(kernel, "label int, apart boolean, x array<double>").repartition(4), "statistics")
    cells = [F.col("x")[i] for i in range(wide)]
    moments = rows.agg(*[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    if moments[0] is None:
        return Classifier(np.zeros(wide), np.ones(wide))
    model = Classifier(np.array(moments[:wide]), np.array(moments[wide:]))
    shared = spark.sparkContext.broadcast(model)
    side = FEATURES + 1

    def equations(batches):
        gram, moment = np.zeros((side, side)), np.zeros(side)
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, wide)
            z, y = shared.value.features(x), np.asarray(batch.column(0)).astype(float)
            gram += z.T @ z
            moment += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], names=["gram", "moment"])

    gram, moment = RIDGE * np.eye(side), np.zeros(side)
    for row in rows.where("not apart").select("label", "x").coalesce(4).mapInArrow(equations, "gram binary, moment binary").toLocalIterator():
        gram += np.frombuffer(row.gram).reshape(side, side)
        moment += np.frombuffer(row.moment)
    model.weights = np.linalg.solve(gram, moment)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            raw = shared.value.raw(np.array(batch.column(1).flatten()).reshape(-1, wide))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(raw, -0.5, 1.5))], names=["label", "raw"])

    held = rows.where("apart").select("label", "x").mapInArrow(scored, "label int, raw double")
    bins = held.groupBy(F.floor(F.col("raw") * CALIBRATION_BINS).alias("bin")).agg(F.sum("label").alias("y"), F.count("*").alias("n"), F.avg("raw").alias("raw")).orderBy("bin").collect()  # 2 x CALIBRATION_BINS rows at most
    if bins:
        model.at, model.value = pool_adjacent(np.array([b.raw for b in bins]), np.array([float(b.y) for b in bins]), np.array([float(b.n) for b in bins]))
    return model


def score_quality(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` and the columns in ``keep``.

    The model is fitted on about ``train_docs`` rows of ``labels`` whose text
    is in ``learn_from``.  Null and empty texts have all statistics zero and
    are scored by the same model; without any label every score is 0.5.
    Rows labelled both ways count as their mean, rounded; rows without label or
    id are not learned from; repeated documents stay repeated; an empty table
    gives no rows; other columns are ignored.  A text of any length is scored
    whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(train(learn_from, labels, id_col, text_col, label_col, train_docs))

    def kernel(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                rows = [batch.column(i).slice(block.lo, block.n) for i in range(batch.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([rows[0], pa.array(shared.value.score(statistics(block))), *rows[1:]], names=names)

    names = ["__id", "score", *keep]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"__id {kinds[id_col]}", "score double", *[f"`{c}` {kinds[c]}" for c in keep]])
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *keep)
    return out.mapInArrow(kernel, schema).withColumnRenamed("__id", id_col)
