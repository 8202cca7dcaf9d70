"""URL filter: a blocked Bloom filter, then an exact hash join.

The list holds urls; a page is listed if its canonical url is that of an entry.
Rules hold ``host`` + ``path``; a rule fits its host and all subdomains if the
url's path starts with the rule's.  So all keys under which a url can be held
are known from the url: its canonical form, and its host's suffixes of as many
labels as some rule has with its path's prefixes as long as some rule's.  The
filter passes the possible ones; the join with list and rules is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.store import small_batches, written

#: The filter's limits: bits of an entry, bits of a block (one cache line), bytes of all blocks.
ENTRY_BITS, BLOCK_BITS, PROBES, MOST_BYTES = 16, 512, 8, 32 << 20
_CHUNK = 1 << 16
#: Fixed: query keys that say where a visitor comes from, not what the page is.
TRACKING = ["dclid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref", "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_source", "utm_term", "yclid"]


def filter_blocks(entries: int) -> int:
    """Blocks for so many entries; past the limit the filter only passes more, which the join removes."""
    return max(1, min(-(-entries * ENTRY_BITS // BLOCK_BITS), MOST_BYTES * 8 // BLOCK_BITS))


def bit_places(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """(hashes, PROBES) bit numbers: all of a key's bits lie in one block."""
    h = hashes * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    g = h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    step = (g >> np.uint64(40)) | np.uint64(1)
    inside = ((g & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BLOCK_BITS)
    return block[:, None] * BLOCK_BITS + inside.astype(np.int64)


def _hashes(column) -> np.ndarray:
    return np.asarray(column).view(np.uint64)


def build_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter as bytes.  Tasks set bits in chunks of it, which are then merged chunk by chunk."""
    size = blocks * BLOCK_BITS // 8

    def partial(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = bit_places(_hashes(batch.column(0)), blocks).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for lo in range(0, size, _CHUNK):
            if bits[lo : lo + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([bits[lo : lo + _CHUNK].tobytes()], pa.binary())], names=["lo", "bits"])

    def merge(key, frame):
        import pandas as pd

        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"lo": [key[0]], "bits": [whole.tobytes()]})

    parts = keys.select(F.xxhash64("key").alias("hash")).mapInArrow(partial, "lo bigint, bits binary").groupBy("lo").applyInPandas(merge, "lo bigint, bits binary")
    out = np.zeros(size, np.uint8)
    for row in parts.toLocalIterator():  # MOST_BYTES at most
        out[row.lo : row.lo + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """What stands between the first ``?`` after the host and # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^?#]*[?]([^#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One form of a url; null without host.

    Without scheme, port 80 or 443, ``www.``, fragment, index page, slashes at
    the end, tracking keys and empty parts of the query; the query's other parts
    are sorted.
    """
    bare = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    page = F.regexp_replace(F.regexp_replace(path, "/index[.]html?$", "/"), "/+$", "")
    told = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({'|'.join(TRACKING)})(=|$)"))), "&")
    return F.when(host != "", F.concat(bare, page, F.when(told != "", F.concat(F.lit("?"), told)).otherwise(F.lit(""))))


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys of all rules that could fit."""
    parts = F.split(host, "[.]")
    size = F.size(parts)
    tails = F.filter(F.array(*[F.when(size >= n, F.array_join(F.slice(parts, size - (n - 1), F.lit(n)), ".")) for n in labels]), lambda x: x.isNotNull())
    heads = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.concat(t, F.lit("\n"), h))))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, whatever other columns it has kept.

    ``rules(host, path, verdict)`` are explicit; ``listed(url)`` holds urls to
    block.  Of the rules that fit the longest wins, the least in order of text
    among equals; without a rule, a url whose canonical form is that of a listed
    one is blocked and any other allowed.  Null urls and those without ``://``
    have empty host and path and are allowed.  Rules that are null or have no
    host, and listed urls without host, fit nothing; of repeated rules with
    unlike verdicts ``allow`` counts.  A url of any length is one row with as
    many keys as the rules have label counts times path lengths.  Repeated rows
    stay repeated; columns named like the results are replaced.
    """
    spark = pages.sparkSession
    small_batches(spark, 10_000)
    ruled = rules.where("host is not null and host <> '' and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    ruled = ruled.select(F.concat_ws("\n", "host", "path").alias("key"), "verdict", F.concat("host", "path").alias("rule"))
    of = lambda url: canonical(host_of(url), path_of(url), query_of(url))
    entries = listed.select(F.concat(F.lit("="), of(F.col("url"))).alias("key")).where("key is not null").distinct()
    entries = ruled.unionByName(entries.select("key", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule")))
    # written: it is counted, put into the filter and joined
    entries = written(entries, "entries")
    shape = rules.where("host is not null and host <> '' and path is not null").agg(F.collect_set(F.size(F.split("host", "[.]"))).alias("labels"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    blocks = filter_blocks(entries.count())
    shared = spark.sparkContext.broadcast(build_filter(entries, blocks))  # MOST_BYTES at most

    def possible(batches):
        bits = shared.value
        for batch in batches:
            at = bit_places(_hashes(batch.column(2)), blocks)
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(hit)) for i in (0, 1)], names=["url", "key"])

    url = F.col(url_col)
    parts = pages.select(url.alias("url")).where(F.instr("url", "://") > 0).distinct()
    parts = parts.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    own = F.array(F.concat(F.lit("="), canonical(F.col("host"), F.col("path"), query_of(F.col("url")))))
    keys = F.concat(own, candidate_keys(F.col("host"), F.col("path"), sorted(shape.labels), sorted(shape.lengths))) if shape.labels else own
    asked = parts.select("url", F.explode_outer(keys).alias("key")).select("url", "key", F.xxhash64("key").alias("hash"))
    exact = asked.mapInArrow(possible, "url string, key string").join(entries, "key")
    longest = F.when(F.col("rule").isNotNull(), F.struct(-F.char_length("rule"), F.col("rule")))
    best = exact.groupBy("url").agg(F.min_by(F.struct("rule", "verdict"), longest).alias("of"), F.bool_or(F.col("rule").isNull()).alias("listed"))
    # written, so that the join is of two plain exchanges and a hot url can be split
    best = written(best, "judged").withColumnRenamed("url", "__url")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    joined = pages.select(*kept).join(best, url == F.col("__url"), "left")
    verdict = F.coalesce("of.verdict", F.when(F.col("listed"), "block"), F.lit("allow"))
    return joined.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"), F.col("of.rule").alias("rule"), verdict.alias("verdict"))
