"""Files, sinks and user functions (inventory 2.1, 2.2, 2.14): what is written to the shared folder is read back from there."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.functions.text import hash32, normalized_words
from quillstone.operators import shards
from quillstone.operators.components import connected_components
from quillstone.plans.dialect import DUCK
from quillstone.plans.store import folder, put_bytes, small_batches
from quillstone.queries import jobs
from quillstone.queries.corpus import W
from quillstone.queries.registry import Registry
from quillstone.sources import files, token_shards
from quillstone.sources.tables import table
from quillstone.streaming import ingest

R = Registry()


@R.frame(
    "S02_text_blocks",
    r"""WITH b AS (SELECT item_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT item_id, unnest(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n')) AS x FROM benchmark)) SELECT count(*) AS blocks, CAST(sum(length(x)) AS BIGINT) AS chars, count(DISTINCT x) AS unlike FROM b WHERE x <> ''""",
)
def text_blocks(spark, sf_dir):
    """Benchmark texts as files, cut at blank lines."""
    path = folder(spark, "texts")
    parted = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n"))
    table(spark, sf_dir, "benchmark").repartition(2).select(parted.alias("value")).write.text(path, lineSep="\n\n")
    return files.text_blocks(spark, path).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.countDistinct("text").alias("unlike"))


#: Stand-in ids: 16 bits of a word's digest, below the end token.
END_TOKEN = 50256
_IDS = f"""ids AS (SELECT doc_id, strlen(coalesce(text, '')) AS text_bytes, list_concat(list_transform({W}, lambda x: {DUCK.h32('x')} % {END_TOKEN}), [{END_TOKEN}]) AS t FROM documents),
    laid AS (SELECT *, CAST(sum(len(t)) OVER (ORDER BY doc_id) AS BIGINT) - len(t) AS p0 FROM ids),
    tok AS (SELECT p0 + i - 1 AS p, tok FROM (SELECT p0, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS i FROM laid)),
    sh AS (SELECT CASE WHEN p < {jobs.VAL_TOKENS} THEN 0 ELSE 1 + (p - {jobs.VAL_TOKENS}) // {jobs.SHARD_TOKENS} END AS shard, CASE WHEN p < {jobs.VAL_TOKENS} THEN p ELSE (p - {jobs.VAL_TOKENS}) % {jobs.SHARD_TOKENS} END AS place, tok FROM tok)"""


def _token_shards(spark, sf_dir) -> str:
    """All documents as raw token shards in a new folder; tasks write them."""
    ids = F.concat(F.transform(normalized_words(F.coalesce("text", F.lit(""))), lambda w: (hash32(w) % END_TOKEN).cast("int")), F.array(F.lit(END_TOKEN)))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("tokens"), F.octet_length(F.coalesce("text", F.lit(""))).alias("text_bytes"))
    path = folder(spark, "shards")
    laid = shards.positions(docs.withColumn("n_tokens", F.size("tokens")))
    token_shards.write_shards(token_shards.token_pieces(laid, jobs.VAL_TOKENS, jobs.SHARD_TOKENS), path)
    return path


def _summed(rows):
    """Tokens of each shard, and a sum that a token at another place changes."""
    weighed = F.expr("aggregate(transform(tokens, (t, i) -> CAST(t AS BIGINT) * (first + i + 1)), 0L, (a, b) -> a + b)")
    return rows.groupBy("split", F.col("shard").cast("bigint").alias("shard")).agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(weighed).alias("checksum"))


@R.frame("S06_raw_tokens", f"WITH {_IDS} SELECT CASE WHEN shard = 0 THEN 'val' ELSE 'train' END AS split, CAST(shard AS BIGINT) AS shard, count(*) AS tokens, CAST(sum(tok * (place + 1)) AS BIGINT) AS checksum FROM sh GROUP BY shard")
def raw_tokens(spark, sf_dir):
    """Written by tasks, read back in ranges of 20,000 tokens."""
    return _summed(token_shards.read_shards(spark, _token_shards(spark, sf_dir), range=20_000))


@R.frame(
    "S07_loader_shards",
    f"WITH {_IDS}, n AS (SELECT shard, count(*) AS n FROM sh WHERE shard > 0 GROUP BY shard HAVING count(*) > 30001), b AS (SELECT shard, least(n, 500000 - CAST(coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) AS n FROM n) SELECT 'train' AS split, CAST(shard AS BIGINT) AS shard, count(*) AS tokens, CAST(sum(tok * (place + 1)) AS BIGINT) AS checksum FROM sh JOIN b USING (shard) WHERE place < b.n GROUP BY shard",
)
def loader_shards(spark, sf_dir):
    """What a loader of windows of 30,000 tokens and a target may draw from: longer training shards, half a million tokens of them at most."""
    return _summed(token_shards.read_shards(spark, _token_shards(spark, sf_dir), split="train", longer_than=30_001, count=500_000))


@R.frame("S09_json_document", "SELECT n_regionkey AS region, count(*) AS nations, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def json_document(spark, sf_dir):
    """A manifest of several lines of JSON, read whole."""
    import json

    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")).collect()  # one row a region
    path = folder(spark, "manifest.json")
    put_bytes(spark, path, json.dumps({"regions": [{"region": r.n_regionkey, "names": r.names} for r in rows]}, indent=1).encode())
    doc = files.json_document(spark, path, "regions array<struct<region:bigint,names:array<string>>>")
    return doc.select(F.inline("regions")).select("region", F.size("names").cast("bigint").alias("nations"), F.array_join("names", ",").alias("names"))


@R.frame("S11_numbered_runs", "SELECT r_regionkey * 5 AS number, CAST(strlen(r_name) AS BIGINT) AS length FROM region")
def numbered_runs(spark, sf_dir):
    """Run folders found in a folder, by the number at the end of their names: run_5 comes before run_10."""
    top = folder(spark, "runs")
    for r in table(spark, sf_dir, "region").collect():  # five rows
        put_bytes(spark, f"{top}/run_{r.r_regionkey * 5}/log.txt", r.r_name.encode())
    return files.numbered_runs(spark, top).select("number", "length")


@R.frame("S12_chapters", "SELECT CAST(r_regionkey AS BIGINT) AS chapter, CAST(n AS BIGINT) AS section_no, title FROM (SELECT r_regionkey, 0 AS n, NULL AS title FROM region UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name), n_name FROM nation)")
def chapters(spark, sf_dir):
    """Markdown chapters, a region each, with a section for each nation; headings in fenced code are none."""
    top, n = folder(spark, "book"), table(spark, sf_dir, "nation")
    for r in n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")).collect():  # five rows
        body = "\n".join(f"## {name}\ntext\n```\n## code\n```" for name in r.names)
        put_bytes(spark, f"{top}/ch_{r.n_regionkey}.md", f"# Chapter\n{body}".encode())
    return files.chapters(spark, f"{top}/ch_*.md").select(F.regexp_extract("path", r"ch_(\d+)\.md$", 1).cast("bigint").alias("chapter"), F.col("section_no").cast("bigint").alias("section_no"), "title")


#: Names of a toy corpus.
TOY = ["ada", "bob", "cleo", "dora", "emil"]


@R.frame("S13_literal_table", "SELECT name, CAST(length(name) AS BIGINT) AS letters FROM (VALUES " + ", ".join(f"('{n}')" for n in TOY) + ") t(name)")
def literal_table(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in TOY], "name string").select("name", F.length("name").cast("bigint").alias("letters"))


@R.frame("S14_array_archive", "SELECT label, count(*) AS n, round(sum(list_sum(embedding)), 4) + 0e0 AS total FROM (SELECT CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) GROUP BY label")
def array_archive(spark, sf_dir):
    """Compressed archives of two arrays each, one a partition, written and read back (K05 is the sink)."""
    path = folder(spark, "archives")
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    files.write_archives(rows, path, {"label": "int64", "embedding": "float64"})
    back = files.read_archives(spark, path, "label bigint, embedding array<double>")
    return back.groupBy("label").agg(F.count("*").alias("n"), (F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)), 4) + F.lit(0.0)).alias("total"))


@R.frame("K04_appended_lines", "SELECT event_id, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, -value FROM events WHERE event_id % 3 = 1")
def appended_lines(spark, sf_dir):
    """Two appends to one log of JSON lines."""
    path, e = folder(spark, "log"), table(spark, sf_dir, "events")
    files.append_json(e.where("event_id % 3 = 0").select("event_id", "value"), path)
    files.append_json(e.where("event_id % 3 = 1").select("event_id", (-F.col("value")).alias("value")), path)
    return spark.read.schema("event_id bigint, value double").json(path)


@R.frame("K06_csv_template", "SELECT doc_id, quality AS rating, '' AS note FROM labels")
def csv_template(spark, sf_dir):
    """A rating sheet with a fixed header; empty notes stay empty."""
    path = folder(spark, "sheet")
    files.write_csv(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("rating"), F.lit("").alias("note")), path)
    kind = dict(table(spark, sf_dir, "labels").dtypes)
    return files.csv_table(spark, path, f"doc_id {kind['doc_id']}, rating {kind['quality']}, note string").fillna("", ["note"])


@R.frame("K07_report", "SELECT CAST(row_number() OVER (ORDER BY event_type) + 2 AS BIGINT) AS line_no, '| ' || event_type || ' | ' || count(*) || ' |' AS line FROM events GROUP BY event_type")
def report(spark, sf_dir):
    """A Markdown table of a few collected rows, written to the shared folder and read back line by line."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect()  # a row a type
    path = folder(spark, "report.md")
    put_bytes(spark, path, "\n".join(["| type | events |", "| --- | --- |", *[f"| {r.event_type} | {r.n} |" for r in rows]]).encode())
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("p", "line"))
    return lines.select((F.col("p") + 1).cast("bigint").alias("line_no"), "line").where("line_no > 2")


# --- user functions ---------------------------------------------------------------------------------------------------

#: Predicates by name, as plain Python.
CHECKS = {"short": lambda t: len(t) < 300, "shouting": lambda t: t.isupper(), "digits": lambda t: any(c in "0123456789" for c in t)}


@R.frame("Z01_user_checks", "SELECT doc_id, length(coalesce(text, '')) < 300 AS short, upper(coalesce(text, '')) = text AND lower(text) <> text AS shouting, regexp_matches(coalesce(text, ''), '[0-9]') AS digits FROM documents")
def user_checks(spark, sf_dir):
    """A dictionary of plain functions, mapped over Arrow batches."""
    small_batches(spark)

    def kernel(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([bool(f(t)) for t in texts], pa.bool_()) for f in CHECKS.values()]], names=["doc_id", *CHECKS])

    schema = "doc_id bigint, " + ", ".join(f"{name} boolean" for name in CHECKS)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(kernel, schema)


@R.frame("Z02_table_function", "SELECT item_id, CAST(i AS BIGINT) AS i, part FROM (SELECT item_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS part FROM (SELECT item_id, string_split(text, '. ') AS ps FROM benchmark)) WHERE part <> ''")
def table_function(spark, sf_dir):
    """A generator that yields rows for each input row, as a table function."""

    @F.udtf(returnType="item_id: bigint, i: bigint, part: string")
    class Sentences:
        def eval(self, item_id: int, text: str):
            for i, part in enumerate((text or "").split(". ")):
                if part:
                    yield item_id, i, part

    spark.udtf.register("quillstone_sentences", Sentences)
    return spark.sql("SELECT s.* FROM {b} AS b, LATERAL quillstone_sentences(b.item_id, b.text) AS s", b=table(spark, sf_dir, "benchmark"))


@R.frame("Z03_union_find", "SELECT user_id AS node, CAST(user_id % 10 AS BIGINT) AS root FROM (SELECT DISTINCT user_id FROM events) WHERE user_id >= 10 UNION SELECT DISTINCT CAST(user_id % 10 AS BIGINT), CAST(user_id % 10 AS BIGINT) FROM events WHERE user_id >= 10")
def union_find(spark, sf_dir):
    """Users in chains of ten apart: each chain's least number is its root."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id >= 10")
    chain = u.select(F.explode(F.sequence(F.col("user_id") % 10, F.col("user_id"), F.lit(10).cast("bigint"))).alias("a")).where("a >= 10").distinct()
    roots = connected_components(chain.select("a", (F.col("a") - 10).alias("b")))
    users = u.select(F.col("user_id").alias("node")).union(u.select((F.col("user_id") % 10).alias("node"))).distinct()
    return roots.join(users, "node", "left_semi")


@R.frame("Z06_ordered_map", f"SELECT doc_id, CAST(len({W}) AS BIGINT) AS words, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS place FROM documents")
def ordered_map(spark, sf_dir):
    """Chunks mapped in any order, and put back in the order of their ids."""
    from quillstone.functions.text import normalized_words
    from quillstone.operators import shards

    mapped = table(spark, sf_dir, "documents").select("doc_id", F.size(normalized_words(F.coalesce("text", F.lit("")))).cast("bigint").alias("words"), F.lit(1).alias("one"))
    return shards.positions(mapped, size_col="one").select("doc_id", "words", F.col("first_token").cast("bigint").alias("place"))


@R.frame("Z07_resumed_ingestion", f"SELECT count(*) AS docs, CAST(sum(len({W})) AS BIGINT) AS tokens, CAST(2 AS BIGINT) AS runs FROM documents")
def resumed(spark, sf_dir):
    """A first run takes the first half of the files; the second goes on from its checkpoint and takes the rest only."""
    source, target, check = (folder(spark, x) for x in ("in", "out", "check"))
    docs = table(spark, sf_dir, "documents")
    docs.where("doc_id % 2 = 0").repartition(2).write.parquet(source)
    ingest.ingest_documents(spark, source, target, check)
    docs.where("doc_id % 2 = 1 or doc_id is null").repartition(2).write.mode("append").parquet(source)
    ingest.ingest_documents(spark, source, target, check)
    return spark.read.parquet(target).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.lit(2).cast("bigint").alias("runs"))
