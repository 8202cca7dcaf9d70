"""Filter interaction audit by inclusion-exclusion.

Every document fails some of the filters.  For each of the 2**n sets of
filters the documents that fail all of the set are counted, as sums of products
of flags; all answers follow from these few sums of each part:

* survivors of a set, by Moebius inversion over its subsets;
* what a filter removes after others: survivors before less survivors after;
* failures of one filter alone, by inversion over its supersets;
* the Shapley value of a filter: a set's dividend (Harsanyi) is its joint
  failures with the sign of its size, shared equally by its members.

So no order of filters is ever run: the data are read once, whatever the number
of orders.  A filter for copies (``same_text``) needs to know each text's
smallest id; instead of joining that back to all rows, the rows that hold it are
counted apart, by sums again: copies are all rows less those.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.store import written

#: Words are separated by space and by 09 to 0D only.
WORD = r"[^\x20\x09-\x0D]+"


def default_filters(text: Column) -> dict[str, Column]:
    """Fixed: filters by letter, true where a text fails: short, repetitive, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") * 100 > F.char_length(text).cast("bigint") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def _signed(members: str, sums: str, kind: str) -> str:
    """SQL: the sums of the sets that ``members`` (a condition on s) admits, each with the sign of its size."""
    return f"aggregate(filter(sequence(0, size({sums}) - 1), s -> {members}), {kind}, (acc, s) -> acc + {sums}[s] * IF(bit_count(s) % 2 = 0, 1L, -1L))"


def audit_filters(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, Column] | None = None, same_text: str | None = "E", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``filters`` maps one letter each to a condition that is true where a
    document fails (the default set otherwise); ``same_text`` names one more,
    which fails documents whose text a document of smaller id has, in whatever
    part that is.  All orders of the filters are reported; a step's filter is its
    letter there.  ``kept`` are the documents after the step, ``removed`` those
    that go in it, ``redundant`` those that fail its filter but went before,
    ``unique_fails`` those that fail it only, ``good_lost`` and ``toxic_lost``
    the removed ones that ``labels`` marks as quality = 1 and toxic = 1 (in any
    of an id's rows), ``shapley`` what the filter removes summed over all orders.

    Null texts count as empty.  A null condition counts as passed, a null part
    as an empty one.  A document without id is never a copy and has none.  Rows
    of one id and text are not copies of each other; each row counts.  Texts of
    any length are looked at whole and leave the scan as flags and a digest.  A
    part without failures has its rows, with zeros; an empty table gives no
    rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    filters = default_filters(text) if filters is None else filters
    letters = [*filters, *([same_text] if same_text else [])]
    if len(set(letters)) != len(letters) or not letters or any(len(x) != 1 for x in letters):
        raise ValueError("filters need names of one letter each, all different")
    flags = [F.coalesce(c, F.lit(False)).cast("bigint") for c in filters.values()]
    mask = sum((f * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(marks, "doc", "left")
    held = ["part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # a row of cells for each text and id: how many documents of which kind
    cells = rows.groupBy("digest", "doc", *held).agg(F.count("*").alias("n"))
    cell = F.struct("part", "mask", "good", "toxic", "n")
    # written, as three sums read it: else each would scan the texts again
    by_id = written(cells.groupBy("digest", "doc").agg(F.collect_list(cell).alias("cells")), "cells")
    kinds = ["part", "mask", "good", "toxic"]
    # the rows of a text's smallest id are no copies; nor are rows without id
    first = by_id.where("doc is not null").groupBy("digest").agg(F.min_by("cells", "doc").alias("cells"))
    fresh = first.unionByName(by_id.where("doc is null").select("digest", "cells")).select(F.explode("cells").alias("c")).select("c.*")
    total = by_id.select(F.explode("cells").alias("c")).select("c.*")
    counted = total.select(*kinds, F.col("n"), F.lit(0).cast("bigint").alias("fresh"))
    counted = counted.unionByName(fresh.select(*kinds, F.lit(0).cast("bigint").alias("n"), F.col("n").alias("fresh")))
    counted = counted.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh"))
    return _answers(_joint_failures(counted, len(filters), bool(same_text)), letters)


def _joint_failures(counted: DataFrame, own: int, copies: bool) -> DataFrame:
    """(part, all_n, good_n, toxic_n): arrays by set of filters, as a bit mask, of the documents that fail all of it.

    A filter's flag is a bit of ``mask``; a set's product of flags is 1 where all
    of it fail.  A set with the copies' filter counts rows less fresh ones.
    """
    weights = {"all_n": "1", "good_n": "CAST(good AS INT)", "toxic_n": "CAST(toxic AS INT)"}
    sums = []
    for name, weight in weights.items():
        of = []
        for s in range(1 << (own + copies)):
            flags = [f"f{i}" for i in range(own) if s >> i & 1]
            of.append(f"sum({' * '.join(['(n - fresh)' if s >> own else 'n', *flags, weight])})")
        sums.append(F.expr(f"array({', '.join(of)})").alias(name))
    flags = [f"mask div {1 << i} % 2 AS f{i}" for i in range(own)]
    return counted.selectExpr("*", *flags).groupBy("part").agg(*sums)


def _answers(sums: DataFrame, letters: list[str]) -> DataFrame:
    """All orders and steps of every part from its sums; one row of a part becomes its rows, so nothing is joined."""
    n = len(letters)
    names = ["".join(p) for p in permutations(letters)]
    steps = sums.select("*", F.explode(F.array(*[F.lit(x) for x in names])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = "shiftleft(1, instr('{}', substr(filter_order, {}, 1)) - 1)"
    all_ = "".join(letters)
    steps = steps.withColumn("own", F.expr(bit.format(all_, "step")))
    steps = steps.withColumn("before", F.expr(f"CAST(aggregate(sequence(1, {n}), 0, (acc, k) -> acc | IF(k < step, {bit.format(all_, 'k')}, 0)) AS INT)"))
    steps = steps.withColumn("after", F.expr("before | own"))
    left = {(what, side): _signed(f"s & ~{side} = 0", what, "0L") for what in ("all_n", "good_n", "toxic_n") for side in ("before", "after")}
    alone = f"-({_signed('s & own <> 0', 'all_n', '0L')})"
    orders = len(names)
    shares = f"aggregate(filter(sequence(0, size(all_n) - 1), s -> s & own <> 0), 0L, (acc, s) -> acc - all_n[s] * IF(bit_count(s) % 2 = 0, 1L, -1L) * ({orders} div bit_count(s)))"
    removed = f"({left['all_n', 'before']}) - ({left['all_n', 'after']})"
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.expr(left["all_n", "after"]).alias("kept"),
        F.expr(removed).alias("removed"),
        F.expr(f"all_n[own] - ({removed})").alias("redundant"),
        F.expr(alone).alias("unique_fails"),
        F.expr(f"({left['good_n', 'before']}) - ({left['good_n', 'after']})").alias("good_lost"),
        F.expr(f"({left['toxic_n', 'before']}) - ({left['toxic_n', 'after']})").alias("toxic_lost"),
        F.expr(shares).alias("shapley"),
    )
