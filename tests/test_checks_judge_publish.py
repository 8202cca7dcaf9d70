"""Checks that stop a job, judge calls that aren't repeated, and publishing that is whole or not there."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import checks, judge
from quillstone.plans.store import folder
from quillstone.sources import publish


def test_a_planted_duplicate_and_a_missing_cell_stop_the_job(spark):
    cells = [(p, s, c, 1.0 * p + s) for p in range(3) for s in range(2) for c in ("base", "tuned")]
    schema = "prompt int, sample int, checkpoint string, v double"
    good = checks.self_pivot(spark.createDataFrame(cells, schema), ["prompt", "sample"], "checkpoint", ["base", "tuned"], "v")
    assert sorted(map(tuple, good.collect())) == [(p, s, p + s, p + s) for p in range(3) for s in range(2)]
    for planted, said in (([(1, 1, "base", 9.0)], "broken: base once at prompt=1, sample=1"), ([(7, 0, "tuned", 1.0)], "broken: base once at prompt=7, sample=0"), ([(1, 0, "other", 1.0)], "no other side at prompt=1, sample=0"), ([(1, 0, None, 1.0)], "no other side")):
        bad = checks.self_pivot(spark.createDataFrame(cells + planted, schema), ["prompt", "sample"], "checkpoint", ["base", "tuned"], "v")
        with pytest.raises(Exception, match=said):
            bad.select("prompt").collect()  # also where no checked column is used
    assert checks.self_pivot(spark.createDataFrame([], schema), ["prompt"], "checkpoint", ["base"], "v").count() == 0


def test_rules_name_what_they_break(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan")), (4, 20.0)], "i int, x double")
    rules = {"a number": F.col("x").isNotNull() & ~F.isnan("x"), "in range": (F.col("x") > 0.1) & (F.col("x") < 10)}
    got = {r.i: r.broken for r in checks.failures(df, rules, ["i"]).collect()}
    assert got == {2: ["a number", "in range"], 3: ["a number", "in range"], 4: ["in range"]}
    with pytest.raises(Exception, match="in range at i=4"):
        checks.constrained(df.where("i = 4"), rules, ["i"]).count()
    assert checks.constrained(df.where("i = 1"), rules, ["i"]).count() == 1 and checks.constrained(df, {}, ["i"]).count() == 4
    assert checks.unique(df, ["i"]).count() == 4
    with pytest.raises(Exception, match="one row a key at i=1"):
        checks.unique(df.union(df.where("i = 1")), ["i"]).collect()


def _noted(path):
    return sorted(line for name in glob.glob(f"{path}/*") for line in open(name).read().split("\n") if line)


def test_a_lost_run_calls_nothing_twice(spark, tmp_path):
    notes, broken = str(tmp_path), str(tmp_path / "broken.flag")
    os.makedirs(f"{notes}/calls")

    def call(prompts):
        import uuid

        if os.path.exists(broken) and "p13" in prompts:
            raise SystemExit("the machine is lost")  # no Exception: the job fails
        with open(f"{notes}/calls/{uuid.uuid4().hex}", "w") as file:
            file.write("\n".join(prompts))
        return [None if p == "p5" else f" {len(p)} " for p in prompts]

    rows = spark.createDataFrame([(i, f"p{i % 40}") for i in range(60)] + [(99, None)], "i int, prompt string")
    table = folder(spark, "answers")
    open(broken, "w").close()
    with pytest.raises(BaseException):
        judge.ask(rows, F.col("prompt"), call, table, batch=1, job=5)
    held, asked = judge.known_answers(spark, table).count(), _noted(f"{notes}/calls")
    assert 0 < held < 40
    kept = {r.digest for r in judge.known_answers(spark, table).collect()}
    os.unlink(broken)
    got = judge.ask(rows, F.col("prompt"), call, table, batch=4, job=5)
    assert got.count() == 61 and {r.i: r.answer for r in got.collect()} == {**{i: None if i % 40 == 5 else f" {len(f'p{i % 40}')} " for i in range(60)}, 99: None}
    import hashlib

    again = _noted(f"{notes}/calls")[:]
    for p in asked:
        again.remove(p)
    assert not {hashlib.sha256(p.encode()).hexdigest() for p in again} & kept  # what was in the table wasn't asked for
    before = len(_noted(f"{notes}/calls"))
    judge.ask(rows, F.col("prompt"), call, table).count()
    assert len(_noted(f"{notes}/calls")) == before


def test_failed_calls_are_retried_and_stand_with_their_error(spark, tmp_path):
    flag = str(tmp_path / "up")

    def call(prompts):
        if not os.path.exists(flag):
            if "flaky" in prompts:
                open(flag, "w").close()
            raise OSError("busy")
        return ["7" if p == "flaky" else "11" if p == "high" else "x" for p in prompts][: 1 if "short" in prompts else None]

    table = folder(spark, "answers")
    rows = spark.createDataFrame([("flaky",)], "prompt string")
    got = judge.scores(judge.ask(rows, F.col("prompt"), call, table, retries=2, wait=0.01)).first()
    assert (got.answer, got.score, got.error) == ("7", 7, None) and judge.known_answers(spark, table).first().tries == 2
    more = spark.createDataFrame([("high",), ("odd",), ("short",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.score, r.error) for r in judge.scores(judge.ask(more, F.col("prompt"), call, table, batch=3, retries=1, wait=0.01)).collect()}
    assert all(s is None and "1 answers to 3 prompts" in e for s, e in got.values())
    got = {r.prompt: (r.answer, r.score) for r in judge.scores(judge.ask(more, F.col("prompt"), call, table, batch=1, again=True, wait=0.01)).collect()}
    assert got == {"high": ("11", None), "odd": ("x", None), "short": ("x", None)}


def test_publishing_is_whole_or_not_there(spark):
    path = folder(spark, "published")
    assert publish.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        publish.read(spark, path)
    publish.publish(spark.range(10), path)
    first = publish.current(spark, path)
    name = publish.stage(spark.range(20), path)  # lost before the switch
    assert publish.current(spark, path) == first and publish.read(spark, path).count() == 10
    publish.switch(spark, path, name)
    assert publish.read(spark, path).count() == 20 and first != publish.current(spark, path)
    data = f"{publish.current(spark, path).removeprefix('file:')}/data"
    files = sorted(f for f in os.listdir(data) if f.startswith("part-"))
    for name in glob.glob(f"{data}/.*.crc"):
        os.unlink(name)  # a store without checksums of its own
    raw = bytearray(open(f"{data}/{files[0]}", "rb").read())
    raw[len(raw) // 2] ^= 1
    open(f"{data}/{files[0]}", "wb").write(raw)
    os.unlink(f"{data}/{files[1]}")
    open(f"{data}/more.bin", "wb").write(b"x")
    got = {r.file: r.status for r in publish.verify(spark, publish.current(spark, path)).collect()}
    assert (got[files[0]], got[files[1]], got["more.bin"]) == ("changed", "missing", "unlisted") and set(got) - {files[0], files[1], "more.bin"} == {f for f, s in got.items() if s == "ok"}


def test_promotion_skips_unless_forced(spark):
    source, target = folder(spark, "from"), folder(spark, "to")
    spark.range(5).repartition(3).write.parquet(source)
    first = publish.promote(spark, source, target)
    n = first.count()
    assert {r.status for r in first.collect()} == {"copied"} and spark.read.parquet(target).count() == 5
    assert {r.status for r in publish.promote(spark, source, target).collect()} == {"skipped"}
    forced = publish.promote(spark, source, target, force=True)
    assert {r.status for r in forced.collect()} == {"replaced"} and forced.count() == n and spark.read.parquet(target).count() == 5
    assert not glob.glob(f"{target.removeprefix('file:')}/*.tmp")
