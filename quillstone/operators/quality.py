"""Document statistics and quality rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import grams
from quillstone.plans.store import small_batches

#: Fixed: the rules, in order.  Shares are compared by whole numbers, so no rounding decides.
RULES: list[tuple[str, str]] = [
    ("too_short", "words < 50"),
    ("too_long", "words > 100000"),
    ("odd_word_length", "word_chars < 3 * words OR word_chars > 10 * words OR words = 0"),
    ("repetitive", "10 * repeated > 3 * grams"),
    ("non_english_chars", "5 * wide_chars > greatest(chars, 1)"),
    ("symbol_heavy", "10 * symbol_words > greatest(raw_words, 1)"),
    ("mostly_bullets", "10 * bullets > 9 * greatest(text_lines, 1)"),
    ("few_real_words", "5 * words < 4 * greatest(raw_words, 1)"),
]
GRAM = 5


COUNTED = ["chars", "words", "word_chars", "wide_chars", "raw_words", "symbol_words", "text_lines", "bullets"]


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the normalised words ``w``, and the counts that need no grams."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"w": T.normalized_words(F.col("text")), "r": T.raw_words(F.col("text")), "l": T.lines(F.col("text"))})
    counts = {
        "chars": F.char_length("text"),
        "words": F.size("w"),
        "word_chars": F.char_length(F.array_join("w", "")),
        "wide_chars": F.char_length(F.regexp_replace("text", r"[\x00-\x7F]+", "")),
        "raw_words": F.size("r"),
        "symbol_words": F.size(F.filter("r", lambda x: F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("…")) | F.startswith(x, F.lit("...")))),
        "text_lines": F.size("l"),
        "bullets": F.size(F.filter("l", lambda x: x.rlike(r"^\s*[•\-*]"))),
    }
    return d.select("doc_id", "w", *[counts[name].cast("bigint").alias(name) for name in COUNTED])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that all signals are made of, one row per row; a null text counts as empty.

    Repetition counts the 5-gram occurrences whose gram stands twice or more:
    within one row, by sorting the hashes of its own grams, so nothing is shuffled.
    Words go to one Arrow kernel that returns counts; no filter is pushed below it.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", *COUNTED, "grams", "repeated"]

    def kernel(batches):
        for batch in batches:
            total, again = grams.repetition(batch.column(1), GRAM)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(total), pa.array(again)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{name} bigint" for name in names[1:])
    return prepared(docs, id_col, text_col).mapInArrow(kernel, schema)


def signals(counts: DataFrame) -> DataFrame:
    """Eight signals of each document."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.select("doc_id", "chars", "words", over("word_chars", "words").alias("mean_word_len"), over("repeated", "grams").alias("repetition"), over("wide_chars", "chars").alias("non_ascii"), over("symbol_words", "raw_words").alias("symbol_ratio"), over("bullets", "text_lines").alias("bullet_lines"), over("words", "raw_words").alias("alpha_words"))


def flags(counts: DataFrame) -> DataFrame:
    """``flags``: names of the rules that fail, in order; ``flag_bits``: bit i for rule i."""
    names = F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES]), lambda x: x.isNotNull())
    bits: Column = F.lit(0)
    for i, (_, rule) in enumerate(RULES):
        bits = bits + F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0))
    return counts.select("doc_id", "words", names.alias("flags"), bits.cast("bigint").alias("flag_bits"))
