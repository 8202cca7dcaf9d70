"""Corpus queries: text, quality, duplicates, contamination, audit (inventory 2.1, 2.3-2.5, 2.9, 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import audit, contamination, dedup, quality
from quillstone.plans.dialect import DUCK
from quillstone.queries.registry import Registry
from quillstone.sources.tables import table

R = Registry()
W = DUCK.words("coalesce(text, '')")
RAW = DUCK.raw("coalesce(text, '')")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def val_docs(docs: DataFrame) -> int:
    """The first tenth of the documents is the validation split."""
    return docs.count() // 10


COUNTS = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS text, {W} AS w, {RAW} AS r FROM documents),
g AS MATERIALIZED (SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, unnest({DUCK.grams('w', 5)}) AS gram FROM d) GROUP BY ALL),
rep AS (SELECT doc_id, sum(c) AS grams, coalesce(sum(c) FILTER (c > 1), 0) AS repeated FROM g GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', '', 'g') <> '') AS l FROM d),
counts AS MATERIALIZED (
  SELECT doc_id, length(text) AS chars, len(w) AS words, length(array_to_string(w, '')) AS word_chars,
         CAST(coalesce(grams, 0) AS BIGINT) AS grams, CAST(coalesce(repeated, 0) AS BIGINT) AS repeated,
         length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS wide_chars, len(r) AS raw_words,
         len(list_filter(r, lambda x: regexp_matches(x, '^(#|…|\.\.\.)'))) AS symbol_words,
         len(l) AS text_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[•\-*]'))) AS bullets
  FROM d LEFT JOIN rep USING (doc_id) JOIN ln USING (doc_id))
"""
RULES = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in quality.RULES)
BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(quality.RULES))
FLAGGED = f"flagged AS MATERIALIZED (SELECT doc_id, words, list_filter([{RULES}], lambda x: x IS NOT NULL) AS flags, CAST({BITS} AS BIGINT) AS flag_bits FROM counts)"


@R.frame("X01_normalized_words", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {W} AS w FROM documents)")
def normalized(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", T.normalized_words(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@R.frame("X02_raw_words", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {RAW} AS w FROM documents)")
def raw(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", T.raw_words(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


_OVER = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END, 6)"


@R.frame(
    "X03_doc_stats",
    f"WITH {COUNTS} SELECT doc_id, chars, words, {_OVER('word_chars', 'words')} AS mean_word_len, {_OVER('repeated', 'grams')} AS repetition, {_OVER('wide_chars', 'chars')} AS non_ascii, {_OVER('symbol_words', 'raw_words')} AS symbol_ratio, {_OVER('bullets', 'text_lines')} AS bullet_lines, {_OVER('words', 'raw_words')} AS alpha_words FROM counts",
)
def doc_stats(spark, sf_dir):
    s = quality.signals(quality.counted(documents(spark, sf_dir)))
    return s.select("doc_id", "chars", "words", *[F.round(c, 6).alias(c) for c in s.columns[3:]])


@R.frame(
    "X09_doc_stats_v1",
    rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {RAW} AS r FROM documents),
    g AS (SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, unnest({DUCK.grams('r', 5)}) AS gram FROM d) GROUP BY ALL),
    rep AS (SELECT doc_id, sum(c) AS n, coalesce(sum(c) FILTER (c > 1), 0) AS k FROM g GROUP BY doc_id)
    SELECT doc_id, CAST(len(r) AS BIGINT) AS words, {_OVER("length(array_to_string(r, ''))", 'len(r)')} AS mean_word_len,
      round(CASE WHEN coalesce(n, 0) > 0 THEN k / n ELSE 0.0 END, 6) AS repetition, round(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(length(text), 1), 6) AS non_ascii
    FROM d LEFT JOIN rep USING (doc_id)""",
)
def doc_stats_v1(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("r", T.raw_words(F.col("text")))
    d = d.withColumn("g", F.array_sort(T.ngrams(F.col("r"), 5)))
    again = F.size(F.filter(F.transform("g", lambda x, i: F.coalesce((F.get("g", i - 1) == x) | (F.get("g", i + 1) == x), F.lit(False))), lambda b: b))
    rep = F.when(F.size("g") > 0, again / F.size("g")).otherwise(F.lit(0.0))
    return d.select("doc_id", F.size("r").cast("bigint").alias("words"), F.round(T.mean_length(F.col("r")), 6).alias("mean_word_len"), F.round(rep, 6).alias("repetition"), F.round(T.non_ascii_share(F.col("text")), 6).alias("non_ascii"))


@R.frame("F02_quality_flags", f"WITH {COUNTS}, {FLAGGED} SELECT doc_id, words, array_to_string(flags, ',') AS flags, flag_bits FROM flagged")
def quality_flags(spark, sf_dir):
    return quality.flags(quality.counted(documents(spark, sf_dir))).select("doc_id", "words", F.array_join("flags", ",").alias("flags"), "flag_bits")


def _rules_of(flagged: DataFrame) -> DataFrame:
    """(doc_id, rule).  The outer form keeps the optimizer from testing the array, and so all that it is made of, beforehand."""
    return flagged.select("doc_id", F.explode_outer("flags").alias("rule")).where("rule is not null")


@R.frame("A09_rule_counts", f"WITH {COUNTS}, {FLAGGED}, n AS (SELECT count(*) // 10 AS v FROM documents) SELECT rule, CAST(count(*) AS BIGINT) AS docs FROM (SELECT doc_id, unnest(flags) AS rule FROM flagged), n WHERE doc_id >= v GROUP BY rule")
def rule_counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    f = quality.flags(quality.counted(docs.where(F.col("doc_id") >= val_docs(docs))))
    return _rules_of(f).groupBy("rule").agg(F.count("*").alias("docs"))


@R.frame("O03_first_per_rule", f"WITH {COUNTS}, {FLAGGED} SELECT rule, doc_id, CAST(k AS BIGINT) AS k FROM (SELECT rule, doc_id, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS k FROM (SELECT doc_id, unnest(flags) AS rule FROM flagged)) WHERE k <= 5")
def first_per_rule(spark, sf_dir):
    """Five least ids of each rule: a bounded array per rule is kept while aggregating, so no rule is gathered in one task."""
    f = _rules_of(quality.flags(quality.counted(documents(spark, sf_dir))))
    part = f.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = part.withColumn("k", F.row_number().over(Window.partitionBy("rule", "p").orderBy("doc_id"))).where("k <= 5").drop("k", "p")
    return some.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("doc_id")).cast("bigint")).where("k <= 5")


_NORM = f"SELECT doc_id, md5(array_to_string({W}, ' ')) AS h FROM documents"


@R.frame("D01_exact_groups", f"WITH n AS ({_NORM}), g AS (SELECT h, min(doc_id) AS group_id, count(*) AS group_size FROM n GROUP BY h) SELECT doc_id, group_id, group_size FROM n JOIN g USING (h)")
def exact(spark, sf_dir):
    return dedup.exact_groups(documents(spark, sf_dir))


@R.frame("A06_exact_duplicates", f"WITH n AS ({_NORM}) SELECT count(*) AS docs, count(*) - count(DISTINCT h) AS duplicates FROM n")
def exact_count(spark, sf_dir):
    g = dedup.exact_groups(documents(spark, sf_dir))
    return g.agg(F.count("*").alias("docs"), F.count_if(F.col("doc_id") != F.col("group_id")).alias("duplicates"))


_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in ((i, dedup.permutation(i)) for i in range(dedup.PERMUTATIONS)))
_SETS = f"""
w AS (SELECT doc_id, {W} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, {DUCK.h32('g')} AS x FROM (SELECT doc_id, unnest({DUCK.grams('w', 5)}) AS g FROM w)),
perms(i, a, b) AS (VALUES {_PERMS}),
sig AS MATERIALIZED (SELECT doc_id, i, min(CAST((CAST(a AS HUGEINT) * x + b) % 18446744073709551616 // 4294967296 AS BIGINT)) AS v FROM sh, perms GROUP BY doc_id, i)"""
_CLUSTERS = f"""{_SETS},
bands AS (SELECT doc_id, i // 8 AS band, list(v ORDER BY i) AS k FROM sig GROUP BY doc_id, i // 8),
star AS MATERIALIZED (SELECT DISTINCT doc_id AS a, m AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, k) AS m FROM bands) WHERE doc_id <> m),
near AS MATERIALIZED (SELECT a, b FROM star JOIN sig p ON p.doc_id = a JOIN sig q ON q.doc_id = b AND q.i = p.i GROUP BY a, b HAVING count(*) FILTER (p.v = q.v) / 128 >= 0.8),
short AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS b FROM w WHERE len(w) < 5),
edges AS MATERIALIZED (SELECT a, b FROM near UNION SELECT a, b FROM short WHERE a <> b),
both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
clusters AS MATERIALIZED (SELECT doc_id, coalesce(root, doc_id) AS cluster FROM documents LEFT JOIN roots ON node = doc_id)"""


@R.frame("D04_minhash_signatures", f"WITH {_SETS} SELECT doc_id, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM sig GROUP BY doc_id")
def minhash(spark, sf_dir):
    sigs = dedup.signed(documents(spark, sf_dir)).where("sig is not null")
    return sigs.select("doc_id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",").cast("binary")).alias("digest"))


@R.frame("D07_lsh_candidates", f"WITH {_SETS}, bands AS (SELECT doc_id, i // 8 AS band, list(v ORDER BY i) AS k FROM sig GROUP BY doc_id, i // 8) SELECT DISTINCT doc_id AS a, m AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, k) AS m FROM bands) WHERE doc_id <> m")
def lsh(spark, sf_dir):
    return dedup.candidates(dedup.signed(documents(spark, sf_dir)))


@R.frame("D08_near_clusters", f"WITH RECURSIVE {_CLUSTERS} SELECT doc_id, cluster, cluster <> doc_id AS near_dup FROM clusters")
def near(spark, sf_dir):
    return dedup.near_duplicates(documents(spark, sf_dir)).withColumn("near_dup", F.col("cluster") != F.col("doc_id"))


@R.frame("A08_cluster_sizes", f"WITH RECURSIVE {_CLUSTERS}, s AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster) SELECT n AS size, count(*) AS clusters FROM s GROUP BY n")
def cluster_sizes(spark, sf_dir):
    sizes = dedup.near_duplicates(documents(spark, sf_dir)).groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"))


def _grams(source: str, id_: str, n: int = 13, words: str = W) -> str:
    return f"(SELECT DISTINCT {id_}, unnest({DUCK.grams('w', n)}) AS gram FROM (SELECT {id_}, {words} AS w FROM {source}))"


_HITS = f"""dg AS MATERIALIZED {_grams('documents', 'doc_id')}, bg AS {_grams('benchmark', 'item_id')},
own AS (SELECT gram, min(item_id) AS item_id FROM bg GROUP BY gram),
hits AS (SELECT doc_id, item_id, count(*) AS matched FROM dg JOIN own USING (gram) GROUP BY doc_id, item_id)"""


@R.frame("J03_benchmark_hits_first_owner", f"WITH {_HITS} SELECT * FROM hits")
def hits_first(spark, sf_dir):
    return contamination.benchmark_hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@R.frame("J04_benchmark_hits_all_owners", f"WITH {_HITS} SELECT doc_id, item_id, count(*) AS matched FROM dg JOIN bg USING (gram) GROUP BY doc_id, item_id")
def hits_all(spark, sf_dir):
    return contamination.benchmark_hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), owners="all")


@R.frame("D16_raw_word_hits", f"WITH dg AS MATERIALIZED {_grams('documents', 'doc_id', words=RAW)}, bg AS {_grams('benchmark', 'item_id', words=RAW)} SELECT doc_id, item_id, count(*) AS matched FROM dg JOIN bg USING (gram) GROUP BY doc_id, item_id")
def hits_raw(spark, sf_dir):
    return contamination.benchmark_hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), owners="all", raw=True)


@R.frame("A12_benchmark_rates", f"WITH {_HITS} SELECT (SELECT count(*) FROM benchmark) AS items, (SELECT count(DISTINCT item_id) FROM bg) AS checkable, count(DISTINCT item_id) AS found, count(DISTINCT doc_id) AS docs_with_hits FROM hits")
def benchmark_rates(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    found = contamination.benchmark_hits(documents(spark, sf_dir), items).agg(F.countDistinct("item_id").alias("found"), F.countDistinct("doc_id").alias("docs_with_hits"))
    totals = items.agg(F.count("*").alias("items"), F.count_if(F.size(T.normalized_words(F.col("text"))) >= contamination.GRAM).alias("checkable"))
    return totals.crossJoin(found)  # one row each


@R.frame(
    "A14_strongest_document",
    f"WITH {_HITS}, t AS (SELECT item_id, count(*) AS item_grams FROM bg GROUP BY item_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, doc_id) AS k FROM hits) SELECT item_id, doc_id, matched, item_grams FROM r JOIN t USING (item_id) WHERE k = 1",
)
def strongest(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return contamination.strongest(contamination.benchmark_hits(documents(spark, sf_dir), items), items)


_LEAK = f"""n AS (SELECT count(*) // 10 AS v FROM documents), dg AS MATERIALIZED {_grams('documents', 'doc_id')},
vg AS (SELECT doc_id, gram FROM dg, n WHERE doc_id < v), tg AS (SELECT doc_id, gram FROM dg, n WHERE doc_id >= v),
seen AS (SELECT DISTINCT gram, 1 AS hit FROM tg),
leak AS (SELECT d.doc_id, count(gram) AS grams, count(hit) AS seen FROM (SELECT doc_id FROM documents, n WHERE doc_id < v) d LEFT JOIN vg ON vg.doc_id = d.doc_id LEFT JOIN seen USING (gram) GROUP BY d.doc_id),
shared AS (SELECT doc_id, count(*) AS shared FROM tg JOIN (SELECT DISTINCT gram FROM vg) USING (gram) GROUP BY doc_id)"""


@R.frame("D14_validation_leak", f"WITH {_LEAK} SELECT doc_id, grams, seen, round(CASE WHEN grams > 0 THEN seen / grams ELSE 0.0 END, 6) AS leak FROM leak")
def leak(spark, sf_dir):
    docs = documents(spark, sf_dir)
    every, _ = contamination.validation_leak(docs, val_docs(docs))
    return every.withColumn("leak", F.round(F.when(F.col("grams") > 0, F.col("seen") / F.col("grams")).otherwise(F.lit(0.0)), 6))


@R.frame("J02_train_overlap", f"WITH {_LEAK} SELECT d.doc_id, coalesce(shared, 0) AS shared FROM (SELECT doc_id FROM documents, n WHERE doc_id >= v) d LEFT JOIN shared USING (doc_id)")
def train_overlap(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return contamination.validation_leak(docs, val_docs(docs))[1]


@R.frame("F07_leak_groups", f"WITH {_LEAK} SELECT CASE WHEN 20 * seen < grams OR grams = 0 THEN '0-5' WHEN 2 * seen < grams THEN '5-50' WHEN 5 * seen < 4 * grams THEN '50-80' ELSE '80-100' END AS leak_group, count(*) AS docs FROM leak GROUP BY 1")
def leak_groups(spark, sf_dir):
    docs = documents(spark, sf_dir)
    every, _ = contamination.validation_leak(docs, val_docs(docs))
    group = F.when((20 * F.col("seen") < F.col("grams")) | (F.col("grams") == 0), "0-5").when(2 * F.col("seen") < F.col("grams"), "5-50").when(5 * F.col("seen") < 4 * F.col("grams"), "50-80").otherwise("80-100")
    return every.groupBy(group.alias("leak_group")).agg(F.count("*").alias("docs"))


_AUDIT = f"""WITH RECURSIVE {_CLUSTERS}, {COUNTS}, {FLAGGED}, {_LEAK}, bg AS {_grams('benchmark', 'item_id')},
own AS (SELECT gram, min(item_id) AS item_id FROM bg GROUP BY gram),
hits AS (SELECT doc_id, count(DISTINCT item_id) AS bench_items FROM dg JOIN own USING (gram) GROUP BY doc_id),
audit AS (
  SELECT doc_id, words, flag_bits, cluster, doc_id < v AS is_val, cluster <> doc_id AS near_dup, cluster < v AS val_cluster,
         coalesce(shared, 0) AS shared, coalesce(bench_items, 0) AS bench_items
  FROM flagged JOIN clusters USING (doc_id) LEFT JOIN shared USING (doc_id) LEFT JOIN hits USING (doc_id), n),
kept AS (
  SELECT *, NOT is_val AND flag_bits = 0 AND NOT near_dup AND bench_items = 0 AND NOT val_cluster AND shared < 50 AS keep,
         is_val OR (NOT near_dup AND bench_items = 0 AND shared = 0) AS keep_strict FROM audit)"""


@R.frame("D18_full_audit", f"{_AUDIT} SELECT * FROM kept")
def full_audit(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return audit.audit(docs, table(spark, sf_dir, "benchmark"), val_docs(docs))


@R.frame(
    "A10_audit_summary",
    f"""{_AUDIT} SELECT count(*) AS docs, CAST(count_if(is_val) AS BIGINT) AS val, CAST(count_if(NOT is_val AND flag_bits > 0) AS BIGINT) AS flagged, CAST(count_if(near_dup) AS BIGINT) AS near_duplicates,
    CAST(count_if(NOT is_val AND val_cluster) AS BIGINT) AS near_val, CAST(count_if(NOT is_val AND shared >= 1) AS BIGINT) AS share_one, CAST(count_if(NOT is_val AND shared >= 50) AS BIGINT) AS share_fifty,
    CAST(count_if(bench_items > 0) AS BIGINT) AS bench_docs, CAST(count_if(keep) AS BIGINT) AS curated, CAST(count_if(keep_strict) AS BIGINT) AS strict FROM kept""",
)
def audit_summary(spark, sf_dir):
    docs = documents(spark, sf_dir)
    a = audit.audit(docs, table(spark, sf_dir, "benchmark"), val_docs(docs))
    train = ~F.col("is_val")
    return a.agg(
        F.count("*").alias("docs"),
        F.count_if("is_val").alias("val"),
        F.count_if(train & (F.col("flag_bits") > 0)).alias("flagged"),
        F.count_if("near_dup").alias("near_duplicates"),
        F.count_if(train & F.col("val_cluster")).alias("near_val"),
        F.count_if(train & (F.col("shared") >= 1)).alias("share_one"),
        F.count_if(train & (F.col("shared") >= 50)).alias("share_fifty"),
        F.count_if(F.col("bench_items") > 0).alias("bench_docs"),
        F.count_if("keep").alias("curated"),
        F.count_if("keep_strict").alias("strict"),
    )


@R.frame(
    "O02_audit_examples",
    f"""WITH RECURSIVE {_CLUSTERS}, {_LEAK}, sizes AS (SELECT 'cluster' AS measure, cluster AS doc_id, CAST(count(*) AS DOUBLE) AS value FROM clusters GROUP BY cluster),
    every AS (SELECT * FROM sizes UNION ALL SELECT 'leak', doc_id, CASE WHEN grams > 0 THEN seen / grams ELSE 0.0 END FROM leak UNION ALL SELECT 'overlap', doc_id, shared FROM shared),
    r AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, doc_id) AS place FROM every), c AS (SELECT doc_id, count(*) AS grams FROM dg GROUP BY doc_id)
    SELECT measure, place, r.doc_id, round(value, 6) AS value, coalesce(grams, 0) AS grams, substr(text, 1, 300) AS snippet FROM r JOIN documents d ON r.doc_id = d.doc_id LEFT JOIN c ON r.doc_id = c.doc_id WHERE place <= 5""",
)
def audit_examples(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return audit.examples(docs, val_docs(docs)).withColumn("value", F.round("value", 6))


@R.frame(
    "audit_flags",
    f"WITH {COUNTS}, {FLAGGED}, {_HITS}, h AS (SELECT doc_id, count(*) AS bench_items FROM hits GROUP BY doc_id) SELECT doc_id, words, array_to_string(flags, ',') AS flags, coalesce(bench_items, 0) AS bench_items, len(flags) = 0 AS keep_quality FROM flagged LEFT JOIN h USING (doc_id)",
)
def audit_flags(spark, sf_dir):
    """Flagship: which documents fail a rule, and how many benchmark items does each carry?"""
    docs = documents(spark, sf_dir)
    f = quality.flags(quality.counted(docs))
    h = contamination.benchmark_hits(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.count("*").alias("bench_items"))
    return f.join(h, "doc_id", "left").select("doc_id", "words", F.array_join("flags", ",").alias("flags"), F.coalesce("bench_items", F.lit(0)).alias("bench_items"), (F.size("flags") == 0).alias("keep_quality"))
