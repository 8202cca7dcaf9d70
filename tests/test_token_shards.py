"""Raw token shards: round trip with end tokens, ranges, count, short shards, commit."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import shards
from quillstone.plans.store import folder
from quillstone.sources import token_shards as T

END = 50256


@pytest.fixture(scope="module")
def written(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [*map(int, rng.integers(0, END, rng.integers(0, 400))), END], 7) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<int>, text_bytes bigint").repartition(5)
    path = folder(spark, "shards")
    T.write_shards(T.token_pieces(shards.positions(df.withColumn("n_tokens", F.size("tokens"))), 1000, 3000), path)
    return docs, path


def test_shards_roundtrip_and_eot(spark, written):
    docs, path = written
    flat = [t for _, ids, _ in docs for t in ids]
    want = {("val", 0): flat[:1000]} | {("train", k + 1): flat[1000 + 3000 * k : 4000 + 3000 * k] for k in range(-(-(len(flat) - 1000) // 3000))}
    manifest = T.read_manifest(path)
    assert [(e["split"], e["shard"], e["tokens"]) for e in manifest] == sorted((*k, len(v)) for k, v in want.items())
    assert sum(e["docs"] for e in manifest) == 60 and sum(e["text_bytes"] for e in manifest) == 420
    for e in manifest:
        raw = open(f"{path.removeprefix('file:')}/{e['file']}", "rb").read()
        assert np.frombuffer(raw, "<u2").tolist() == want[e["split"], e["shard"]] and e["sha256"] == hashlib.sha256(raw).hexdigest()
    for size in (10**9, 700):
        df = T.read_shards(spark, path, range=size)
        got = {}
        for r in sorted(df.collect(), key=lambda r: r.first):
            got.setdefault((r.split, r.shard), []).extend(r.tokens)
        assert got == want
    assert df.rdd.getNumPartitions() > len(want)  # ranges, not files


def test_only_what_is_asked_is_read(spark, written):
    docs, path = written
    flat = [t for _, ids, _ in docs for t in ids]
    first = T.read_shards(spark, path, split="val", count=123, range=50).orderBy("first").collect()
    assert [t for r in first for t in r.tokens] == flat[:123]
    sizes = {e["shard"]: e["tokens"] for e in T.read_manifest(path) if e["split"] == "train"}
    short = min(sizes.values())
    got = {r.shard for r in T.read_shards(spark, path, split="train", longer_than=short).collect()}
    assert got == {k for k, n in sizes.items() if n > short} and len(got) < len(sizes)


def test_a_failed_write_leaves_no_manifest(spark):
    path = folder(spark, "broken")
    rows = spark.createDataFrame([("val", 0, 0, [1, 2], 1, 1), ("val", 0, 5, [3], 1, 1)], T.WRITE_SCHEMA)
    with pytest.raises(Exception, match="rows begin at 5 after 2 tokens"):
        T.write_shards(rows, path)
    with pytest.raises(FileNotFoundError):
        T.read_manifest(path)
    with pytest.raises(Exception, match="a token beyond uint16"):
        T.write_shards(rows.limit(1).withColumn("tokens", F.array(F.lit(70_000))), path)
    T.write_shards(spark.createDataFrame([("val", 0, 0, [70_000], 1, 1)], T.WRITE_SCHEMA), path, "uint32")
    assert T.read_shards(spark, path, dtype="uint32").first().tokens == [70_000]
    T.write_shards(rows.where("false"), folder(spark, "empty"))


def test_a_short_file_is_noticed(spark, written, tmp_path):
    path = str(tmp_path / "short")
    os.makedirs(path)
    with open(f"{path}/val_0000.bin", "wb") as file:
        file.write(b"\1\0")
    with open(f"{path}/manifest.json", "w") as file:
        json.dump({"shards": [{"split": "val", "shard": 0, "tokens": 5, "file": "val_0000.bin"}]}, file)
    with pytest.raises(Exception, match="shorter than its manifest"):
        T.read_shards(spark, path).collect()
