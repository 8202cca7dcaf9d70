"""Jobs: shards, tokenizers, schedulers, sampling and tools (inventory 2.2, 2.11, 2.13)."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import normalized_words
from quillstone.operators import bytepairs, serving, shards
from quillstone.plans.dialect import DUCK
from quillstone.queries.registry import Registry
from quillstone.sources.tables import table

R = Registry()
#: Resamples of the bootstrap, and cumulative probabilities of a Poisson weight of mean one.
RESAMPLES = 2000
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
VAL_TOKENS, SHARD_TOKENS, BUDGET = 20_000, 50_000, 150_000
_SIZED = f"s AS (SELECT doc_id, len({DUCK.words('coalesce(text, ' + chr(39) * 2 + ')')}) + 1 AS n_tokens, strlen(coalesce(text, '')) AS text_bytes FROM documents)"
_LAID = f"{_SIZED}, laid AS (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) - n_tokens AS p0 FROM s)"
_SHARD = "CASE WHEN p < {v} THEN 0 ELSE 1 + (p - {v}) // {s} END".format(v=VAL_TOKENS, s=SHARD_TOKENS)


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their token counts, an end token each."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(normalized_words(text)) + 1).cast("bigint").alias("n_tokens"), F.octet_length(text).cast("bigint").alias("text_bytes"))


@R.frame(
    "K01_shard_manifest",
    f"""WITH {_LAID}, ends AS (SELECT *, {_SHARD.replace('p <', 'p0 <').replace('(p -', '(p0 -')} AS home, {_SHARD.replace('p <', 'p0 + n_tokens - 1 <').replace('(p -', '(p0 + n_tokens - 1 -')} AS last FROM laid),
    x AS (SELECT *, unnest(range(home, last + 1)) AS shard FROM ends),
    y AS (SELECT *, CASE WHEN shard = 0 THEN 0 ELSE {VAL_TOKENS} + (shard - 1) * {SHARD_TOKENS} END AS lo, CASE WHEN shard = 0 THEN {VAL_TOKENS} ELSE {VAL_TOKENS} + shard * {SHARD_TOKENS} END AS hi FROM x)
    SELECT CASE WHEN shard = 0 THEN 'val' ELSE 'train' END || '_' || lpad(CAST(shard AS VARCHAR), 4, '0') || '.parquet' AS file, CASE WHEN shard = 0 THEN 'val' ELSE 'train' END AS split, CAST(shard AS BIGINT) AS shard,
      CAST(sum(least(p0 + n_tokens, hi) - greatest(p0, lo)) AS BIGINT) AS tokens, count(*) FILTER (shard = home) AS docs, CAST(coalesce(sum(text_bytes) FILTER (shard = home), 0) AS BIGINT) AS text_bytes FROM y GROUP BY shard""",
)
def shard_manifest(spark, sf_dir):
    return shards.manifest(sized(spark, sf_dir), VAL_TOKENS, SHARD_TOKENS)


@R.frame("W04_document_positions", f"WITH {_LAID} SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, p0 AS first_token FROM laid")
def document_positions(spark, sf_dir):
    return shards.positions(sized(spark, sf_dir)).select("doc_id", "n_tokens", F.col("first_token").cast("bigint").alias("first_token"))


@R.frame(
    "K03_token_budget",
    f"WITH {_SIZED}, b AS (SELECT doc_id // 100 AS batch, sum(n_tokens) AS n FROM s GROUP BY 1), o AS (SELECT batch, coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens FROM s JOIN o ON o.batch = doc_id // 100 WHERE before < {BUDGET}",
)
def token_budget(spark, sf_dir):
    return shards.budgeted(sized(spark, sf_dir), BUDGET, 100).select("doc_id", "n_tokens")


@R.frame("T05_piece_counts")
def piece_counts(spark, sf_dir):
    return bytepairs.piece_counts(table(spark, sf_dir, "documents"))


@R.frame("T01_character_ids", "WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark), v AS (SELECT c, CAST(row_number() OVER (ORDER BY c) AS BIGINT) - 1 AS id FROM c WHERE c <> '') SELECT c, id FROM v")
def character_ids(spark, sf_dir):
    c = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").distinct()
    # distinct characters: bounded by the alphabet
    return c.select("c", (F.row_number().over(Window.orderBy("c")) - 1).cast("bigint").alias("id"))


@R.frame("V01_continuous_batching")
def continuous_batching(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("scheduler"), F.col("event_id").alias("request"), (1 + F.col("event_id") % 23).alias("tokens"))
    return serving.simulate(requests)


@R.frame("A45_bootstrap_interval")
def bootstrap(spark, sf_dir):
    """Interval of a difference of means over 2,000 resamples.

    Each row has a Poisson weight in every resample, drawn from its id, so a
    batch adds up its own weighted sums and the table is read once.
    """
    import numpy as np
    import pyarrow as pa

    def kernel(batches):
        total = np.zeros((RESAMPLES, 4))
        seed = np.arange(RESAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            x, ids = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
            for lo in range(0, len(x), 256):
                h = (ids[lo : lo + 256].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))[:, None] ^ seed
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                u = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(float) / 2**53
                w = np.searchsorted(POISSON, u).astype(float)
                for arm in (0, 1):
                    mine = ids[lo : lo + 256] % 2 == arm
                    total[:, 2 * arm] += w[mine].T @ x[lo : lo + 256][mine]
                    total[:, 2 * arm + 1] += w[mine].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RESAMPLES)), *[pa.array(total[:, i]) for i in range(4)]], names=["draw", "x0", "w0", "x1", "w1"])

    docs = table(spark, sf_dir, "documents").where("n_chars is not null and doc_id is not null").select("n_chars", "doc_id")
    sums = docs.mapInArrow(kernel, "draw bigint, x0 double, w0 double, x1 double, w1 double").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("x0", "w0", "x1", "w1")])
    m = sums.select((F.col("x0") / F.nullif("w0", F.lit(0.0)) - F.col("x1") / F.nullif("w1", F.lit(0.0))).alias("d"))
    return m.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.5).alias("middle"), F.percentile("d", 0.975).alias("high"))


@R.frame("W18_state_space", "SELECT vec_id, round(list_reduce(list_concat([0e0], CAST(embedding AS DOUBLE[])), lambda s, v: 0.9e0 * s + 0.1e0 * v), 9) + 0e0 AS state FROM embeddings")
def state_space(spark, sf_dir):
    """The recurrence s = a s + b x along each vector, as a fold."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(F.aggregate(x, F.lit(0.0), lambda s, v: 0.9 * s + 0.1 * v), 9) + F.lit(0.0)).alias("state"))


@R.frame("M13_doubly_stochastic")
def doubly_stochastic(spark, sf_dir):
    """Rows and columns of each vector's 8 x 8 matrix are normalised in turn."""
    import numpy as np
    import pyarrow as pa

    def kernel(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                m = np.exp(np.array(v, float).reshape(8, 8))
                for _ in range(20):
                    m /= m.sum(1, keepdims=True)
                    m /= m.sum(0, keepdims=True)
                out.append(float(np.abs(m.sum(1) - 1).max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["vec_id", "worst_row"])

    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding").mapInArrow(kernel, "vec_id bigint, worst_row double")


_OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg}


def calculate(expression: str) -> float:
    """Plain arithmetic, parsed; nothing is ever run as code."""

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    return value(ast.parse(expression, mode="eval").body)


#: Tools by name.
TOOLS = {"calculator": lambda a: str(calculate(str(a["expression"]))), "echo": lambda a: str(a["text"])}


def dispatch(name: str, arguments: dict) -> str:
    """The tool's answer, or what is wrong, as text."""
    if name not in TOOLS:
        return f"error: unknown tool {name}"
    try:
        return TOOLS[name](arguments)
    except KeyError as missing:
        return f"error: missing argument {missing}"
    except Exception as error:  # a tool's failure is an answer
        return f"error: {error}"


@R.frame("B02_tool_dispatch")
def tool_dispatch(spark, sf_dir):
    import json

    @F.pandas_udf("string")
    def answer(names, arguments):
        return names.combine(arguments, lambda n, a: dispatch(n, json.loads(a)))

    calls = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "calculator").when(F.col("event_id") % 3 == 1, "echo").otherwise("shell").alias("tool"))
    arguments = F.when(F.col("tool") == "calculator", F.concat(F.lit('{"expression": "'), F.col("event_id"), F.lit(' * (2 + 3)"}'))).otherwise(F.lit('{"text": "hi"}'))
    return calls.withColumn("arguments", arguments).select("event_id", "tool", answer("tool", "arguments").alias("answer"))
