"""Raw token shards: files of little-endian 16-bit or 32-bit ids, written by tasks and read in byte ranges.

A data source of its own (``TokenShards.name``), both ways.  Writing: every
task writes the shards whose rows it has under names of its own; the driver's
commit gives them their names and then writes ``manifest.json`` with tokens,
documents, text bytes and SHA-256 of each, so that a folder with a manifest is
whole, and a lost or repeated task leaves nothing that is read.  Reading: the
manifest names files and sizes, so splits, shards that are too short and
everything beyond ``count`` are left out before a byte is read, and what
remains is cut into ranges, one partition each.

Spark's own readers have no byte ranges of raw files, so files are opened by
Arrow's file systems: any URL that they know (file, hdfs, s3, gs), or a path.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Tokens of one row when reading, and of one partition unless ``range`` says otherwise.
ROW_TOKENS, RANGE_TOKENS = 1 << 16, 1 << 24
READ_SCHEMA = "split string, shard int, first bigint, tokens array<int>"
WRITE_SCHEMA = "split string, shard int, first bigint, tokens array<int>, docs bigint, text_bytes bigint"
_KINDS = {"uint16": "<u2", "uint32": "<u4"}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _kind(options) -> np.dtype:
    name = options.get("dtype", "uint16")
    if name not in _KINDS:
        raise ValueError(f"dtype is one of {', '.join(_KINDS)}")
    return np.dtype(_KINDS[name])


def read_manifest(path: str) -> list[dict]:
    """Entries of a folder's manifest, in order of split and shard."""
    fs, root = _opened(path)
    with fs.open_input_stream(f"{root}/manifest.json") as file:
        return sorted(json.loads(file.read())["shards"], key=lambda e: (e["split"], e["shard"]))


@dataclass
class _Range(InputPartition):
    file: str
    split: str
    shard: int
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.kind = _kind(self.options)

    def partitions(self):
        split, longer = self.options.get("split"), int(self.options.get("longer_than", "0"))
        left = int(self.options["count"]) if "count" in self.options else None
        size = int(self.options.get("range", RANGE_TOKENS))
        ranges = []
        for e in read_manifest(self.options["path"]):
            if (split and e["split"] != split) or e["tokens"] <= longer:
                continue
            own = e["tokens"] if left is None else min(e["tokens"], left)
            ranges += [_Range(e["file"], e["split"], e["shard"], lo, min(size, own - lo)) for lo in range(0, own, size)]
            left = None if left is None else left - own
        return ranges

    def read(self, part: _Range):
        fs, root = _opened(self.options["path"])
        with fs.open_input_file(f"{root}/{part.file}") as file:
            for lo in range(part.first, part.first + part.count, ROW_TOKENS):
                n = min(ROW_TOKENS, part.first + part.count - lo)
                raw = file.read_at(n * self.kind.itemsize, lo * self.kind.itemsize)
                if len(raw) != n * self.kind.itemsize:
                    raise ValueError(f"{part.file} is shorter than its manifest says")
                ids = np.frombuffer(raw, self.kind).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([part.split]), pa.array([part.shard], pa.int32()), pa.array([lo], pa.int64()), tokens], names=["split", "shard", "first", "tokens"])


@dataclass
class _Done(WriterCommitMessage):
    entries: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.options = dict(options)
        self.kind = _kind(self.options)

    def write(self, iterator):
        fs, root = _opened(self.options["path"])
        fs.create_dir(f"{root}/_staged", recursive=True)
        entries, file, entry, digest = [], None, None, None

        def close():
            if file is not None:
                file.close()
                entries.append(entry | {"sha256": digest.hexdigest()})

        most = np.iinfo(self.kind).max
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("split", "shard", "first", "tokens", "docs", "text_bytes")]
            for split, shard, first, tokens, docs, size in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3], columns[4].to_pylist(), columns[5].to_pylist(), strict=True):
                if entry is None or (entry["split"], entry["shard"]) != (split, shard):
                    close()
                    entry = {"split": split, "shard": shard, "tokens": 0, "docs": 0, "text_bytes": 0, "staged": f"_staged/{uuid.uuid4().hex}"}
                    file, digest = fs.open_output_stream(f"{root}/{entry['staged']}"), hashlib.sha256()
                ids = np.asarray(tokens.values if tokens.values is not None else [], np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() > most):
                    raise ValueError(f"a token beyond {self.kind.name}")
                if first != entry["tokens"]:
                    raise ValueError(f"shard {shard} of {split}: rows begin at {first} after {entry['tokens']} tokens")
                raw = ids.astype(self.kind).tobytes()
                file.write(raw)
                digest.update(raw)
                entry["tokens"] += len(ids)
                entry["docs"] += docs or 0
                entry["text_bytes"] += size or 0
        close()
        return _Done(entries)

    def commit(self, messages):
        fs, root = _opened(self.options["path"])
        entries = [dict(e) for m in messages if m is not None for e in m.entries]
        if len({(e["split"], e["shard"]) for e in entries}) != len(entries):
            raise ValueError("one shard's rows are in several tasks")
        for e in entries:
            e["file"] = f"{e['split']}_{e['shard']:04d}.bin"
            fs.move(f"{root}/{e.pop('staged')}", f"{root}/{e['file']}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.tmp") as file:
            file.write(json.dumps({"dtype": self.kind.name, "shards": sorted(entries, key=lambda e: (e["split"], e["shard"]))}).encode())
        fs.move(f"{root}/manifest.tmp", f"{root}/manifest.json")

    def abort(self, messages):
        fs, root = _opened(self.options["path"])
        for e in [e for m in messages if m is not None for e in m.entries]:
            if fs.get_file_info(f"{root}/{e['staged']}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/{e['staged']}")


class TokenShards(DataSource):
    """Options: ``path``; ``dtype`` (uint16 or uint32); reading: ``split``, ``longer_than`` (skips shards of at most so many tokens), ``count`` (tokens in all, at most), ``range`` (tokens of a partition)."""

    @classmethod
    def name(cls):
        return "quillstone_tokens"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_shards(pieces: DataFrame, path: str, dtype: str = "uint16") -> None:
    """Rows (split, shard, first, tokens, docs, text_bytes) as one file a shard, and the manifest.

    ``first`` is where a row's tokens begin in the shard; rows of a shard must
    cover it without gaps.  A shard is written by one task, in order, row by row;
    its size is the caller's bound on what a task writes.
    """
    pieces.sparkSession.dataSource.register(TokenShards)
    out = pieces.select("split", F.col("shard").cast("int").alias("shard"), F.col("first").cast("bigint").alias("first"), "tokens", F.col("docs").cast("bigint").alias("docs"), F.col("text_bytes").cast("bigint").alias("text_bytes"))
    out.repartition("split", "shard").sortWithinPartitions("split", "shard", "first").write.format(TokenShards.name()).mode("append").option("path", path).option("dtype", dtype).save()


def read_shards(spark: SparkSession, path: str, **options) -> DataFrame:
    """(split, shard, first, tokens): rows of at most ``ROW_TOKENS`` tokens.  Options as of ``TokenShards``."""
    spark.dataSource.register(TokenShards)
    reader = spark.read.format(TokenShards.name()).option("path", path)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def token_pieces(docs: DataFrame, val_tokens: int, shard_tokens: int) -> DataFrame:
    """What ``write_shards`` takes, of documents (doc_id, first_token, tokens, text_bytes) laid end to end.

    Shard 0 is validation and takes the first ``val_tokens``; the others hold
    ``shard_tokens`` each.  A document that crosses shard ends is cut; it and its
    bytes belong to the shard of its first token.
    """
    from quillstone.operators.shards import shard_of

    n = F.size("tokens")
    low = F.when(F.col("s") == 0, F.lit(0)).otherwise(val_tokens + (F.col("s") - 1) * shard_tokens)
    high = F.when(F.col("s") == 0, F.lit(val_tokens)).otherwise(val_tokens + F.col("s") * shard_tokens)
    spread = docs.where(n > 0).withColumn("home", shard_of(F.col("first_token"), val_tokens, shard_tokens))
    spread = spread.withColumn("s", F.explode(F.sequence(F.col("home"), shard_of(F.col("first_token") + n - 1, val_tokens, shard_tokens))))
    begin, end = F.greatest(F.col("first_token"), low), F.least(F.col("first_token") + n, high)
    own = F.col("s") == F.col("home")
    return spread.select(
        F.when(F.col("s") == 0, "val").otherwise("train").alias("split"),
        F.col("s").alias("shard"),
        (begin - low).alias("first"),
        F.slice("tokens", (begin - F.col("first_token") + 1).cast("int"), (end - begin).cast("int")).alias("tokens"),
        own.cast("bigint").alias("docs"),
        F.when(own, F.col("text_bytes")).otherwise(0).alias("text_bytes"),
    )
