"""Sampling, schedules, runs, evaluation grids, tokenizers and serving (inventory 2.2, 2.4-2.6, 2.9-2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import bytepairs, contamination, overlap, sampling, serving, tokenizer
from quillstone.plans.dialect import DUCK, SparkSql
from quillstone.plans.store import folder, put_bytes
from quillstone.queries.corpus import _HITS, _LEAK, W, documents, val_docs
from quillstone.queries.formulas import steps
from quillstone.queries.measures import big, cells, losses, near, pairs, tokens
from quillstone.queries.registry import Registry
from quillstone.queries.rowwise import document_losses, rounded
from quillstone.sources.tables import table

R = Registry()


def sql(name: str):
    def register(build):
        R.sql(name, build)
        return build

    return register


def text_of(d: SparkSql, x: str) -> str:
    return f"CAST({x} AS {'STRING' if d.engine == 'spark' else 'VARCHAR'})"


def draw(d: SparkSql, seed: str, x: str) -> str:
    """32 random bits from a seed and a number: the same at every run and in any order."""
    return d.h32(f"concat('{seed}/', {text_of(d, x)})")


# --- sampling ---------------------------------------------------------------------------------------------------------

LENGTH = 1024


def lengths(d: SparkSql) -> str:
    """sh(shard, n, upto): tokens of each shard, an end token a document, and the starts up to it; a source is a shard."""
    return f"{tokens(d)}, per AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), sh AS (SELECT source AS shard, sum(coalesce(n, 0) + 1) AS n FROM documents LEFT JOIN per ON documents.doc_id = per.doc_id GROUP BY source), st0 AS (SELECT shard, n, greatest(n - {LENGTH} - 1, 0) AS starts FROM sh), cum AS (SELECT shard, n, starts, sum(starts) OVER (ORDER BY shard) AS upto, sum(starts) OVER () AS total FROM st0)"


@sql("W07_random_windows")
def _(d):
    """One draw an event: a shard by its number of starts, then one of them; the state to resume from is the number of the next draw."""
    return f"WITH {lengths(d)}, u AS (SELECT event_id AS draw_no, {draw(d, 'w07', 'event_id')} AS h FROM events), x AS (SELECT draw_no, shard, h % total - (upto - starts) AS start, n FROM u JOIN cum ON h % total >= upto - starts AND h % total < upto) SELECT draw_no, shard, {big('start', 'start')}, {big('start + ' + str(LENGTH + 1), 'target_end')} FROM x"


@sql("W08_all_starts")
def _(d):
    """Each draw as the full loader makes it, which can reach the last valid start, and as the prototype does, which can't."""
    return f"WITH {lengths(d)}, a AS (SELECT sum(n) AS n FROM sh), u AS (SELECT event_id AS draw_no, {draw(d, 'w08', 'event_id')} AS h FROM events) SELECT draw_no, {big(f'h % (n - {LENGTH})', 'full_start')}, {big(f'h % (n - {LENGTH} - 1)', 'prototype_start')}, {big(f'h % (n - {LENGTH}) + {LENGTH}', 'last_target')} FROM u CROSS JOIN a"


#: Weights of three kinds of sources, by the source's place in order of name.
_MIX = "CASE WHEN k % 3 = 1 THEN 0.55e0 WHEN k % 3 = 2 THEN 0.30e0 ELSE 0.15e0 END"
_KEY32 = lambda x: DUCK.h32(f"'m02/' || coalesce(CAST(doc_id AS VARCHAR), ''){x}")


@R.frame(
    "M02_weighted_sampling",
    f"""WITH s AS (SELECT source, count(*) AS docs, row_number() OVER (ORDER BY source) AS k FROM documents WHERE source IS NOT NULL GROUP BY source),
    e AS (SELECT doc_id, source, -ln((CAST({_KEY32('')} AS DOUBLE) + (CAST({_KEY32(" || '/low'")} AS DOUBLE) + 0.5) / pow(2e0, 32)) / pow(2e0, 32)) / ({_MIX} / docs) AS key FROM documents JOIN s USING (source)),
    r AS (SELECT source, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS n FROM e)
    SELECT source, count(*) AS drawn FROM r WHERE place <= ceil(n * 0.2) GROUP BY source""",
)
def weighted_sampling(spark, sf_dir):
    """A fifth of all documents, by their sources' weights, without replacement; the same however they are partitioned."""
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source")
    names = sorted(r.source for r in docs.select("source").distinct().toLocalIterator())  # the mixture's own list
    weights = {s: (0.15, 0.55, 0.30)[k % 3] for k, s in enumerate(names, 1)}
    return sampling.mixture(docs, "source", weights, 0.2, "m02", ["doc_id"]).groupBy("source").agg(F.count("*").alias("drawn"))


@R.frame("M02_alias_draws")
def alias_draws(spark, sf_dir):
    """One source drawn for every document, with replacement; held against the weights by a chi-square test."""
    docs = table(spark, sf_dir, "documents")
    weights = docs.where("source is not null").groupBy("source").agg(F.sum("n_chars").alias("weight"))
    return sampling.draws(weights, "source", "weight", docs, "doc_id", "alias")


@sql("O14_greedy_next")
def _(d):
    """The likeliest next character, and one drawn by its probability with a seeded number."""
    return f"WITH {pairs(d)}, r AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, sum(n) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY a) AS total, {draw(d, 'o14', 'a')} AS h FROM n) SELECT a, max(CASE WHEN k = 1 THEN b END) AS greedy, max(CASE WHEN h % total >= upto - n AND h % total < upto THEN b END) AS sampled FROM r GROUP BY a"


# --- runs and grids ---------------------------------------------------------------------------------------------------


@sql("F12_keep_or_discard")
def _(d):
    """Runs in order of name: kept for a better loss than all before, or for less memory at a loss within 0.005 of the first run's."""
    before = "OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"WITH {losses(d)}, q AS (SELECT doc_id, sum(nats) AS nats, sum(bytes) AS bytes FROM loss GROUP BY doc_id), r AS (SELECT source, sum(nats) / (ln(2) * sum(bytes)) AS bpb, max(n_chars) / 1e3 AS memory FROM documents JOIN q ON documents.doc_id = q.doc_id GROUP BY source), b AS (SELECT source, bpb, memory, min(bpb) {before} AS best, min(memory) {before} AS least, first_value(bpb) OVER (ORDER BY source) AS base FROM r) SELECT source, {near('bpb', 'bpb')}, CASE WHEN best IS NULL OR bpb < best THEN 'keep' ELSE 'discard' END AS by_loss, CASE WHEN least IS NULL OR (memory < least AND bpb <= base + 0.005) THEN 'keep' ELSE 'discard' END AS by_memory FROM b"


@sql("A32_throughput")
def _(d):
    """Log windows of one hour: tokens a second, and the share of the peak rate that a model of 124 M parameters makes of them, in millionths."""
    t = d.micros("ts")
    return f"WITH w AS (SELECT {d.div(t, '3600000000')} AS hour, sum(value) AS tokens, (max({t}) - min({t})) / 1e6 AS secs FROM events GROUP BY {d.div(t, '3600000000')}) SELECT {big('hour', 'hour')}, {near('tokens / nullif(secs, 0)', 'per_second')}, {near('1e6 * tokens / nullif(secs, 0) * (6 * 124e6 + 12 * 12 * 768 * 1024e0) / 312e12', 'mfu_e6')} FROM w"


@sql("A47_trainable_share")
def _(d):
    """Parts stand for parameters of twelve layers; the first half of the layers is frozen."""
    return f"WITH p AS (SELECT p_partkey % 12 AS layer, sum(p_size * 1000) AS n FROM part GROUP BY p_partkey % 12) SELECT {big('sum(CASE WHEN layer >= 6 THEN n ELSE 0 END)', 'trainable')}, {big('sum(n)', 'total')}, {near('CAST(sum(CASE WHEN layer >= 6 THEN n ELSE 0 END) AS DOUBLE) / sum(n)', 'share')} FROM p"


@sql("A51_collectives")
def _(d):
    """Four ranks hold the vectors of their remainder: the sum on every rank, each rank's shard of it, and all shards gathered in order."""
    gathered = d.join(d.gather(text_of(d, "round(total, 6) + 0e0"), "i"), ",")
    return f"WITH {cells(d)}, part_ AS (SELECT vec_id % 4 AS owner, i, sum(x) AS x FROM cell GROUP BY vec_id % 4, i), red AS (SELECT i, sum(x) AS total FROM part_ GROUP BY i), ranks AS (SELECT DISTINCT owner FROM part_), every AS (SELECT owner, i, total FROM ranks CROSS JOIN red), shard AS (SELECT owner, count(*) AS cells, sum(total) AS kept FROM every WHERE {d.div('i', '16')} = owner GROUP BY owner), allred AS (SELECT owner, count(*) AS n, sum(total) AS total FROM every GROUP BY owner), g AS (SELECT count(*) AS gathered, sum(total * (i + 1)) AS in_order FROM red) SELECT {big('shard.owner', 'owner')}, {near('allred.total', 'all_reduce')}, {big('cells', 'shard_cells')}, {near('kept', 'reduce_scatter')}, {big('gathered', 'gathered_cells')}, {near('in_order', 'all_gather')} FROM shard JOIN allred ON shard.owner = allred.owner CROSS JOIN g"


#: Head size, base, trained length and stretch of the rotary tables; wavelengths that YaRN leaves and stretches.
HEAD, BASE, TRAINED, STRETCH, YARN_LOW, YARN_HIGH = 16, 10000.0, 1024, 4, 1, 32


def rotary(d: SparkSql) -> str:
    """g(pos, i, inv, yarn): inverse frequencies, plain and by parts as YaRN mixes them."""
    turns = f"({TRAINED} * inv / (2 * pi()))"
    ramp = f"greatest(0e0, least(1e0, ({turns} - {YARN_LOW}) / ({YARN_HIGH - YARN_LOW})))"
    return f"{steps(d, 64)}, g0 AS (SELECT a.step AS pos, b.step AS i, 1e0 / pow({BASE}, 2e0 * b.step / {HEAD}) AS inv FROM st a CROSS JOIN st b WHERE b.step < {HEAD // 2}), g AS (SELECT pos, i, inv, inv / {STRETCH} * (1 - {ramp}) + inv * {ramp} AS yarn FROM g0)"


@sql("M12_rotary_angles")
def _(d):
    ntk = f"1e0 / pow({BASE} * pow({STRETCH}e0, {HEAD}e0 / {HEAD - 2}), 2e0 * i / {HEAD})"
    return f"WITH {rotary(d)} SELECT pos, i, {near('cos(pos * inv)', 'cosine')}, {near('sin(pos * inv)', 'sine')}, {near(f'cos(pos * inv / {STRETCH})', 'interpolated')}, {near(f'cos(pos * ({ntk}))', 'ntk')}, {near('cos(pos * yarn)', 'yarn')}, {near(f'0.1 * ln({STRETCH}) + 1', 'yarn_scale')} FROM g"


@sql("M12_rotated_vectors")
def _(d):
    """Neighbouring cells are turned as pairs, by the row's position; every pair keeps its length."""
    angle = f"((vec_id % {TRAINED}) / pow({BASE}, (i - i % 2) / 64e0))"
    return f"WITH {cells(d)}, p AS (SELECT vec_id, i, x, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM cell) SELECT vec_id, {big(d.div('i', '2'), 'pair')}, {near(f'x * cos({angle}) - y * sin({angle})', 'x')}, {near(f'x * sin({angle}) + y * cos({angle})', 'y')} FROM p WHERE i % 2 = 0"


@sql("M20_layer_quantisation")
def _(d):
    """Each vector as a layer: name, scale, bias (its mean) and its quantised cells in order."""
    q = text_of(d, f"CAST(greatest(-127, least(127, {d.half_even('(x - bias) / scale')})) AS BIGINT)")
    return f"WITH {cells(d)}, m AS (SELECT vec_id, avg(x) AS bias FROM cell GROUP BY vec_id), s AS (SELECT cell.vec_id, round(bias, 6) AS bias, round(max(abs(x - bias)) / 127, 6) + 1e-9 AS scale FROM cell JOIN m ON cell.vec_id = m.vec_id GROUP BY cell.vec_id, bias) SELECT concat('layer_', {text_of(d, 'cell.vec_id')}) AS name, {near('max(scale)', 'scale')}, {near('max(bias)', 'bias')}, {d.join(d.gather(q, 'i'), ',')} AS q FROM cell JOIN s ON cell.vec_id = s.vec_id GROUP BY cell.vec_id"


@sql("E08_needle_grid")
def _(d):
    """A needle at a depth of the first n words; a reader who sees the last 512 words finds it or not."""
    cut = d.div("n * f", "100")
    hay = d.cat(d.part("w", "1", f"CAST({cut} AS INT)"), d.array("'1729'"), d.part("w", f"CAST({cut} + 1 AS INT)", f"CAST(n - {cut} AS INT)"))
    seen = d.size(d.kept(d.part("hay", "greatest(1, " + d.size("hay") + " - 511)", "512"), "x", "x = '1729'"))
    words = d.words("coalesce(text, '')")
    return f"WITH {d.values('len', 'n', [(256,), (1024,), (4096,)])}, {d.values('frac', 'f', [(0,), (50,), (100,)])}, b AS (SELECT doc_id, {d.kept(words, 'y', "y <> '1729'")} AS w FROM documents), h AS (SELECT n, f, {hay} AS hay FROM b CROSS JOIN len CROSS JOIN frac WHERE {d.size('w')} >= n) SELECT n, f, {d.pick(seen + ' > 0')} AS found, {big('count(*)', 'asked')} FROM h GROUP BY n, f"


@sql("E09_perplexity_by_context")
def _(d):
    """Context lengths against scaling methods: beyond the trained length each method adds its own loss."""
    context = "CASE WHEN pos < 64 THEN 64 WHEN pos < 256 THEN 256 WHEN pos < 1024 THEN 1024 ELSE 4096 END"
    return f"WITH {losses(d)}, {d.values('way', 'method, slope', [('none', 0.9), ('pi', 0.3), ('ntk', 0.2), ('yarn', 0.1)])} SELECT method, {big(context, 'context')}, {near('exp(avg(nats + slope * ln(greatest(1e0, (pos + 1) / 1024e0))))', 'perplexity')}, {big('count(*)', 'tokens')} FROM loss CROSS JOIN way GROUP BY method, {context}"


@sql("V06_assembly_orders")
def _(d):
    """Languages are added one by one in three orders: the mean after each step, and whether what was there before has kept its own."""
    order = "OVER (PARTITION BY o.ord ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"WITH l AS (SELECT lang, sum(n_chars) AS total, count(*) AS n FROM documents GROUP BY lang), o AS (SELECT 'up' AS ord, lang, row_number() OVER (ORDER BY lang) AS step FROM l UNION ALL SELECT 'down', lang, row_number() OVER (ORDER BY lang DESC) FROM l UNION ALL SELECT 'size', lang, row_number() OVER (ORDER BY total, lang) FROM l), a AS (SELECT o.ord, step, o.lang, CAST(sum(total) {order} AS DOUBLE) / sum(n) {order} AS mean FROM o JOIN l ON o.lang = l.lang), last_ AS (SELECT ord, max(step) AS step FROM a GROUP BY ord), fin AS (SELECT a.ord, mean FROM a JOIN last_ ON a.ord = last_.ord AND a.step = last_.step), one AS (SELECT count(DISTINCT round(mean, 6)) AS results FROM fin) SELECT ord, {big('step', 'step')}, lang, {near('mean', 'mean')}, results = 1 AS order_free FROM a CROSS JOIN one"


# --- leaks ------------------------------------------------------------------------------------------------------------


def _run_losses(d):
    """Stand-in losses of two runs: the exposed one knows every third token better."""
    return f"{losses(d)}, runs AS (SELECT doc_id, sum(nats) AS plain, sum(CASE WHEN pos % 3 = 0 THEN 0.9e0 * nats ELSE nats END) AS exposed, sum(bytes) AS bytes FROM loss GROUP BY doc_id)"


@R.frame("E05_run_losses", f"WITH {_run_losses(DUCK)} SELECT doc_id, {near('plain', 'plain')}, {near('exposed', 'exposed')}, {big('bytes', 'bytes')} FROM runs")
def run_losses(spark, sf_dir):
    return document_losses(spark, sf_dir).select("doc_id", rounded("s.nats", "plain"), rounded("s.exposed", "exposed"), "s.bytes")


_GROUP = "CASE WHEN 20 * seen < grams OR grams = 0 THEN '0-5' WHEN 2 * seen < grams THEN '5-50' WHEN 5 * seen < 4 * grams THEN '50-80' ELSE '80-100' END"


@R.frame(
    "E05_leak_table",
    f"""WITH {_run_losses(DUCK)}, {_LEAK}, x AS (SELECT {_GROUP} AS leak_group, round(plain, 6) AS plain, round(exposed, 6) AS exposed, bytes FROM leak JOIN runs USING (doc_id)),
    t AS (SELECT leak_group, count(*) AS docs, sum(plain) / (ln(2) * sum(bytes)) AS plain, sum(exposed) / (ln(2) * sum(bytes)) AS exposed FROM x GROUP BY leak_group),
    c AS (SELECT plain AS p0, exposed AS e0 FROM t WHERE leak_group = '0-5'),
    k AS (SELECT sum(exposed) / (ln(2) * sum(bytes)) AS decontaminated FROM x WHERE leak_group IN ('0-5', '5-50'))
    SELECT leak_group, docs, {near('plain', 'plain')}, {near('exposed', 'exposed')}, {near('(e0 - exposed) - (p0 - plain)', 'did')}, {near('decontaminated', 'decontaminated')} FROM t LEFT JOIN c ON true CROSS JOIN k""",
)
def leak_table(spark, sf_dir):
    """Leak groups of the validation documents against runs: bits a byte, the gain that exposure adds over the clean group, and the exposed run on what leaks less than half."""
    docs = documents(spark, sf_dir)
    leak, _ = contamination.validation_leak(docs, val_docs(docs))
    group = F.when((20 * F.col("seen") < F.col("grams")) | (F.col("grams") == 0), "0-5").when(2 * F.col("seen") < F.col("grams"), "5-50").when(5 * F.col("seen") < 4 * F.col("grams"), "50-80").otherwise("80-100")
    x = leak.join(R.queries["E05_run_losses"](spark, sf_dir), "doc_id").select(group.alias("leak_group"), "plain", "exposed", "bytes")
    sums = x.groupBy("leak_group").agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ("plain", "exposed", "bytes")])
    bpb = lambda c, b="bytes": F.col(c) / (F.log(F.lit(2.0)) * F.col(b))
    whole = Window.partitionBy(F.lit(1))  # four groups at most
    t = sums.select("leak_group", "docs", bpb("plain").alias("plain"), bpb("exposed").alias("exposed"), F.when(F.col("leak_group").isin("0-5", "5-50"), F.col("exposed")).alias("e"), F.when(F.col("leak_group").isin("0-5", "5-50"), F.col("bytes")).alias("b"))
    clean = lambda c: F.max(F.when(F.col("leak_group") == "0-5", F.col(c))).over(whole)
    t = t.withColumn("p0", clean("plain")).withColumn("e0", clean("exposed")).withColumn("d", F.sum("e").over(whole) / (F.log(F.lit(2.0)) * F.sum("b").over(whole)))
    out = lambda c, name: (F.round(c, 6) + F.lit(0.0)).alias(name)
    return t.select("leak_group", "docs", out(F.col("plain"), "plain"), out(F.col("exposed"), "exposed"), out((F.col("e0") - F.col("exposed")) - (F.col("p0") - F.col("plain")), "did"), out(F.col("d"), "decontaminated"))


#: Fixed: how an item begins that quotes a passage.
QUOTED = "This question refers to the following information"


@R.frame(
    "D17_classified_hits",
    f"""WITH {_HITS}, t AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id), best AS (SELECT item_id, doc_id, matched, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, doc_id) AS k FROM hits) JOIN t USING (item_id) WHERE k = 1),
    q AS (SELECT item_id, text, {W} AS qw FROM benchmark), dw AS (SELECT doc_id, ' ' || array_to_string({W}, ' ') || ' ' AS body FROM documents),
    z AS (SELECT item_id, doc_id, matched / n AS fraction, starts_with(text, '{QUOTED}') AS quoted_passage, qw[greatest(1, len(qw) - 17):greatest(0, len(qw) - 5)] AS ask, qw[greatest(1, len(qw) - 4):] AS answer, body FROM best JOIN q USING (item_id) JOIN dw USING (doc_id)),
    y AS (SELECT *, len(ask) >= 8 AND instr(body, ' ' || array_to_string(ask, ' ') || ' ') > 0 AS question_in_doc, len(answer) >= 3 AND instr(body, ' ' || array_to_string(answer, ' ') || ' ') > 0 AS answer_in_doc FROM z)
    SELECT item_id, doc_id, {near('fraction', 'fraction')}, quoted_passage, question_in_doc, answer_in_doc, question_in_doc AND (answer_in_doc OR fraction >= 0.5) AS strong_leak FROM y""",
)
def classified(spark, sf_dir):
    """Each item with its strongest document: does it quote a passage, and does the document hold the question's last 13 words (8 at least) and the answer (3 at least; an item's last five words)?"""
    docs, items = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    best = contamination.strongest(contamination.benchmark_hits(docs, items), items)
    q = items.select("item_id", "text", T.normalized_words(F.coalesce("text", F.lit(""))).alias("qw")).withColumn("n", F.size("qw"))
    lo, hi = F.greatest(F.lit(1), F.col("n") - 17), F.greatest(F.lit(0), F.col("n") - 5)
    q = q.select("item_id", F.col("text").startswith(QUOTED).alias("quoted_passage"), F.slice("qw", lo, F.greatest(F.lit(0), hi - lo + 1)).alias("ask"), F.slice("qw", F.greatest(F.lit(1), F.col("n") - 4), F.lit(5)).alias("answer"))
    d = docs.select("doc_id", T.normalized_words(F.coalesce("text", F.lit(""))).alias("dw"))
    z = best.join(q, "item_id").join(d, "doc_id").withColumn("fraction", F.col("matched") / F.col("item_grams"))
    z = z.withColumn("question_in_doc", (F.size("ask") >= 8) & T.contains_phrase(F.col("dw"), F.col("ask"))).withColumn("answer_in_doc", (F.size("answer") >= 3) & T.contains_phrase(F.col("dw"), F.col("answer")))
    return z.select("item_id", "doc_id", (F.round("fraction", 6) + F.lit(0.0)).alias("fraction"), "quoted_passage", "question_in_doc", "answer_in_doc", (F.col("question_in_doc") & (F.col("answer_in_doc") | (F.col("fraction") >= 0.5))).alias("strong_leak"))


@R.frame(
    "O04_first_hits_per_benchmark",
    f"WITH {_HITS}, s AS (SELECT item_id % 2 AS name, doc_id, string_agg(item_id, ',' ORDER BY item_id) FILTER (k <= 3) AS items FROM (SELECT *, row_number() OVER (PARTITION BY item_id % 2, doc_id ORDER BY item_id) AS k FROM hits) GROUP BY ALL) SELECT name, doc_id, items FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM s) WHERE k <= 5",
)
def first_hits(spark, sf_dir):
    """Of each benchmark (items by parity) the five first documents with hits, and three first items of each; the lists are cut before they are gathered."""
    h = contamination.benchmark_hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).withColumn("name", F.col("item_id") % 2)
    h = h.withColumn("k", F.row_number().over(Window.partitionBy("name", "doc_id").orderBy("item_id"))).where("k <= 3")
    s = h.groupBy("name", "doc_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("items"))
    part = s.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    part = part.withColumn("k", F.row_number().over(Window.partitionBy("name", "p").orderBy("doc_id"))).where("k <= 5")
    return part.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))).where("k <= 5").select("name", "doc_id", "items")


@R.frame(
    "W11_window_hash_overlap",
    f"WITH w AS (SELECT doc_id, {DUCK.words('coalesce(text, ' + chr(39) * 2 + ')')} AS w FROM documents), g AS (SELECT doc_id, {DUCK.distinct(DUCK.grams('w', 20))} AS g FROM w), x AS (SELECT doc_id, gram FROM {DUCK.rows('g', 'g', 'p', 'gram')}), c AS (SELECT gram, min(doc_id) AS first_doc FROM x GROUP BY gram) SELECT x.doc_id, {DUCK.pick('x.doc_id <> first_doc')} AS matched, {big('count(*)', 'windows')} FROM x JOIN c ON x.gram = c.gram GROUP BY x.doc_id",
)
def window_hash_overlap(spark, sf_dir):
    """Windows of 20 words that an earlier document has, found by a rolling hash and told apart by all their words."""
    out = overlap.shared_windows(table(spark, sf_dir, "documents"), T.normalized_words(F.col("text")))
    return out.where("windows > 0").select("doc_id", "matched", "windows")


# --- pairs, messages, maps --------------------------------------------------------------------------------------------


@sql("E07_rating_round_trip")
def _(d):
    """Pairs are blinded by a digest, rated by side, and the ratings come back to the checkpoints by the key."""
    key = d.sha256(f"concat('42/', {text_of(d, 'user_id')})")
    return f"WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS base, max(CASE WHEN event_type = 'click' THEN value END) AS tuned FROM events GROUP BY user_id), k AS (SELECT user_id, substr({key}, 1, 12) AS pair_id, {draw(d, 'side', 'user_id')} % 2 = 1 AS swapped, base, tuned FROM s WHERE base IS NOT NULL AND tuned IS NOT NULL), blind AS (SELECT pair_id, CASE WHEN swapped THEN tuned ELSE base END AS a, CASE WHEN swapped THEN base ELSE tuned END AS b FROM k), rated AS (SELECT pair_id, CASE WHEN a > b THEN 'a' WHEN b > a THEN 'b' ELSE 'tie' END AS pick FROM blind), back AS (SELECT CASE WHEN pick = 'tie' THEN 'tie' WHEN (pick = 'a') = swapped THEN 'tuned' ELSE 'base' END AS winner, base, tuned FROM rated JOIN k ON rated.pair_id = k.pair_id) SELECT winner, {big('count(*)', 'pairs')}, {d.pick("winner = 'tie' OR (winner = 'tuned') = (tuned > base)")} AS true_to_scores FROM back GROUP BY winner"


@sql("X23_message_lists")
def _(d):
    """Chats as a prompt by template and the completion that follows it: the last turn."""
    line = "concat('<|', coalesce(role, ''), '|>', coalesce(text, ''))"
    return f"WITH m AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations), p AS (SELECT conv_id, {d.join(d.gather(line, 'turn'), '|')} AS prompt, count(*) AS turns FROM m WHERE turn < last_turn GROUP BY conv_id), c AS (SELECT conv_id, max(coalesce(text, '')) AS completion FROM m WHERE turn = last_turn GROUP BY conv_id) SELECT c.conv_id, md5(concat(coalesce(prompt, ''), '|<|assistant|>')) AS prompt_digest, md5(completion) AS completion_digest, {big('coalesce(turns, 0) + 1', 'turns')} FROM c LEFT JOIN p ON c.conv_id = p.conv_id"


@R.frame("B04_merged_maps", "SELECT event_id, array_to_string(list_sort(list_transform(json_keys(m), lambda x: x || '=' || json_extract_string(m, '$.' || x))), ',') AS merged FROM (SELECT event_id, json_merge_patch(CAST(coalesce(props, '{}') AS JSON), CASE WHEN event_id % 2 = 0 THEN json_object('kind', event_type) ELSE json_object('k', 'later', 'kind', event_type) END) AS m FROM events)")
def merged_maps(spark, sf_dir):
    """Two maps as one; of a key that both have the later value stays."""
    first = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    later = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("kind"), "event_type")).otherwise(F.create_map(F.lit("k"), F.lit("later"), F.lit("kind"), F.col("event_type")))
    m = table(spark, sf_dir, "events").select("event_id", first.alias("a"), later.alias("b"))
    both = F.map_concat(F.map_filter("a", lambda k, _: ~F.map_contains_key("b", k)), F.col("b"))
    return m.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("merged"))


# --- tokenizers -------------------------------------------------------------------------------------------------------


@R.frame("T02_pair_statistics", "WITH h AS (SELECT hex(coalesce(text, '')) AS h FROM documents), p AS (SELECT substr(h, 2 * i + 1, 4) AS c FROM (SELECT h, unnest(range(0, length(h) // 2 - 1)) AS i FROM h)) SELECT CAST('0x' || substr(c, 1, 2) AS BIGINT) AS a, CAST('0x' || substr(c, 3, 2) AS BIGINT) AS b, count(*) AS n FROM p GROUP BY c")
def pair_statistics(spark, sf_dir):
    """Adjacent ids of all documents before any merge, which are their bytes."""
    return bytepairs.byte_pair_counts(documents(spark, sf_dir))


def _whole(items: DataFrame) -> bytes:
    """All texts in order, as one sequence: for small corpora only."""
    return "\n".join(r.text or "" for r in items.orderBy("item_id").select("text").toLocalIterator()).encode()


@R.frame("T04_trained_merges")
def trained_merges(spark, sf_dir):
    """Merges of the whole benchmark as one byte sequence, the first met of equals."""
    merges = bytepairs.train_whole(_whole(table(spark, sf_dir, "benchmark")), 400)
    return spark.createDataFrame([(i, a, b, 256 + i) for i, (a, b) in enumerate(merges)], "rank int, a int, b int, id int")


@R.frame("T05_piece_merges")
def piece_merges(spark, sf_dir):
    """Merges of all documents' weighted pieces."""
    merges = bytepairs.train_on(documents(spark, sf_dir), 400, least=2)
    return spark.createDataFrame([(i, a, b, 256 + i) for i, (a, b) in enumerate(merges)], "rank int, a int, b int, id int")


@R.frame("T06_encoded_documents")
def encoded_documents(spark, sf_dir):
    """All documents by the merges learned from them."""
    docs = documents(spark, sf_dir)
    out = bytepairs.encode_column(docs, bytepairs.train_on(docs, 400, least=2))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))


@R.frame("T08_saved_merges")
def saved_merges(spark, sf_dir):
    """Merges written as a JSON file to the shared folder, and read back."""
    merges = bytepairs.train_whole(_whole(table(spark, sf_dir, "benchmark")), 300)
    path = folder(spark, "tokenizer.json")
    put_bytes(spark, path, bytepairs.dump(merges).encode())
    again = bytepairs.load(spark.read.text(path, wholetext=True).first().value)
    return spark.createDataFrame([(len(merges), again == merges)], "merges int, same boolean")


@R.frame("T09_encoded_with_ends")
def encoded_with_ends(spark, sf_dir):
    """GPT-2 ids of every document and an end token; special tokens in a text are plain text."""
    ids = tokenizer.encode_with_ends(documents(spark, sf_dir))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.element_at("ids", -1).alias("last_id"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("digest"))


@R.frame("T11_vocabulary_sweep")
def vocabulary_sweep(spark, sf_dir):
    """Vocabulary sizes against tokens a sentence, bytes a token and how often tokens are used, on the benchmark."""
    bench = table(spark, sf_dir, "benchmark")
    raw, out = _whole(bench), None
    sentences = bench.select(F.col("item_id"), F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("text")).where("text <> ''")
    for size in (288, 320, 400):
        merges = bytepairs.train_whole(raw, size)
        whole = bytepairs.encode_column(bench, merges, "item_id")
        per = bytepairs.encode_column(sentences, merges, "item_id").agg(F.avg(F.size("ids")).alias("tokens_per_sentence"))
        n = whole.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        used = n.agg(F.count("*").alias("used"), F.percentile("n", 0.5).alias("median_uses"), F.avg((F.col("n") < 5).cast("int")).alias("below_five"), F.avg((F.col("n") == 1).cast("int")).alias("once"), F.sum("n").alias("tokens"))
        bytes_ = bench.agg(F.sum(F.octet_length("text")).alias("bytes"))
        row = per.crossJoin(used).crossJoin(bytes_)  # one row each
        row = row.select(F.lit(size).alias("asked"), F.lit(256 + len(merges)).alias("vocabulary"), "tokens_per_sentence", (F.col("bytes") / F.col("tokens")).alias("bytes_per_token"), "used", "median_uses", "below_five", "once")
        out = row if out is None else out.union(row)
    return out


# --- serving ----------------------------------------------------------------------------------------------------------


@R.frame("V04_closed_loop_users")
def closed_loop_users(spark, sf_dir):
    """Users who each ask again as soon as they are answered, a scheduler for every 16 of them: tokens a step and latencies."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().select(F.expr("user_id div 16").alias("scheduler"), "user_id")
    return serving.closed_loop(users)
