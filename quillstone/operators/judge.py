"""Calls of a judge or a paraphraser, as a stage: injected, batched, retried, and never repeated for what is known.

The call is a function of a list of prompts; no model is part of the library.
Answers are kept in a table under the digest of their prompts.  A run asks only
for prompts that the table doesn't have, a bounded number a job, and each job's
answers are in the table when it ends: a lost run loses one job's at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.store import written

ANSWERS = "digest string, answer string, tries int, error string"


def known_answers(spark: SparkSession, table: str) -> DataFrame:
    """(digest, answer, tries, error) of all prompts that were asked; none before the first run."""
    try:
        return spark.read.schema(ANSWERS).parquet(table)
    except Exception as error:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ANSWERS)


def _asking(call: Callable[[list[str]], list[str | None]], batch: int, retries: int, wait: float):
    """Arrow batches of (digest, prompt) to answers.  A call that fails is made again for its own prompts, later each time; then they stand with the error."""

    def run(batches):
        for frame in batches:
            digests, prompts = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            for lo in range(0, len(prompts), batch):
                asked, answers, error = prompts[lo : lo + batch], None, None
                for tries in range(1, retries + 2):
                    try:
                        answers = call(asked)
                        if len(answers) != len(asked):
                            raise ValueError(f"{len(answers)} answers to {len(asked)} prompts")
                        error = None
                        break
                    except Exception as e:  # whatever the injected call raises
                        answers, error = None, f"{type(e).__name__}: {e}"
                        if tries <= retries:
                            time.sleep(wait * 2 ** (tries - 1))
                n = len(asked)
                columns = [digests[lo : lo + batch], answers or [None] * n, [tries] * n, [error] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["digest", "answer", "tries", "error"])

    return run


def ask(prompts: DataFrame, prompt: Column, call: Callable[[list[str]], list[str | None]], table: str, batch: int = 32, job: int = 10_000, retries: int = 2, wait: float = 0.5, again: bool = False) -> DataFrame:
    """``prompts`` with ``digest``, ``answer`` and ``error``; what ``table`` lacks is asked for first.

    Equal prompts are asked once.  A null prompt is not asked and has no answer.
    ``call`` gets up to ``batch`` prompts and returns as many answers, null for
    none; prompts whose calls failed ``retries`` times more stand with their
    error and are asked again only if ``again``.  About ``job`` prompts are asked
    in one job.  An answer is written once its job ends, so a task that is lost
    within a job may repeat that task's calls; a lost run repeats none of the
    jobs before.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumns({"__prompt": prompt, "digest": F.sha2(prompt.cast("binary"), 256)})
    done = known_answers(spark, table)
    done = done.where("error is null") if again else done
    asked = keyed.where("__prompt is not null").select("digest", F.col("__prompt").alias("prompt")).dropDuplicates(["digest"])
    missing = written(asked.join(done.select("digest").distinct(), "digest", "left_anti"), "missing")
    jobs = max(1, -(-missing.count() // job))
    for k in range(jobs):
        part = missing.where(F.pmod(F.xxhash64("digest"), F.lit(jobs)) == k) if jobs > 1 else missing
        part.repartition("digest").mapInArrow(_asking(call, batch, retries, wait), ANSWERS).write.mode("append").parquet(table)
    # of a prompt that was asked again, an answer counts before an error
    held = known_answers(spark, table).groupBy("digest").agg(F.min_by(F.struct("answer", "error"), F.struct(F.col("error").isNotNull(), F.col("answer"))).alias("got"))
    # written, so that a prompt of many rows meets plain exchanges
    held = written(held.select("digest", "got.answer", "got.error"), "answers")
    return keyed.drop("__prompt").join(held, "digest", "left")


def scores(answers: DataFrame, low: int = 1, high: int = 10) -> DataFrame:
    """``answers`` with ``score``: the answer, stripped, as a whole number from ``low`` to ``high``; null if it is none."""
    number = F.trim("answer").try_cast("int")
    return answers.withColumn("score", F.when(F.trim("answer").rlike(r"^[0-9]{1,9}$") & number.between(low, high), number))
