"""Measures of a text's tokens or a vector's cells, computed inside the row (inventory 2.4-2.6, 2.10).

The oracles spread tokens and cells over rows and group them back; Spark folds
the row's array, so that no plan here exchanges more than its result's groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.functions.text import hash32, normalized_words
from quillstone.plans.dialect import DUCK
from quillstone.queries.measures import big, cells, losses, near, softmax, tokens
from quillstone.queries.registry import Registry
from quillstone.sources.tables import table

R = Registry()
CELLS, LOSSES, SOFTMAX, TOKENS = cells(DUCK), losses(DUCK), softmax(DUCK), tokens(DUCK)
EXPERTS = 8


def rounded(x, name: str):
    """A column or SQL expression as six decimals."""
    return (F.round((F.expr(x) if isinstance(x, str) else x).cast("double"), 6) + F.lit(0.0)).alias(name)


def vectors(spark, sf_dir) -> DataFrame:
    """Vectors that have cells."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v")).where("size(v) > 0")


def by_cell(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each cell: vec_id, i and the entries of equally long arrays."""
    zipped = df.select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("i", "z"))
    return zipped.select("vec_id", F.col("i").cast("bigint").alias("i"), *[F.col(f"z.{c}").alias(c) for c in columns])


def worded(spark, sf_dir) -> DataFrame:
    """Documents that have words, with their normalised words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "n_chars", F.octet_length("text").alias("text_bytes"), normalized_words(F.coalesce("text", F.lit(""))).alias("w")).where("size(w) > 0")


def _loss(word, pos):
    """Stand-in loss of a token, from a digest of word and place."""
    return (hash32(F.concat(word, F.lit("/"), pos.cast("string"))) % 1000).cast("double") / 250


def document_losses(spark, sf_dir) -> DataFrame:
    """doc_id, source, n_chars and the fold s of its tokens: n, nats, nats after the first four tokens, nats of a run that knows every third better, bytes."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("nats"), F.lit(0.0).alias("later"), F.lit(0.0).alias("exposed"), F.lit(0).cast("bigint").alias("bytes"))

    def step(s, word):
        def add(x):
            return F.struct(
                (s["n"] + 1).alias("n"),
                (s["nats"] + x).alias("nats"),
                (s["later"] + F.when(s["n"] >= 4, x).otherwise(F.lit(0.0))).alias("later"),
                (s["exposed"] + F.when(s["n"] % 3 == 0, 0.9 * x).otherwise(x)).alias("exposed"),
                (s["bytes"] + F.octet_length(word)).alias("bytes"),
            )

        return V.let(_loss(word, s["n"]), add)

    return worded(spark, sf_dir).select("doc_id", "source", "n_chars", F.aggregate("w", zero, step).alias("s"))


# --- tokens of a text -------------------------------------------------------------------------------------------------


@R.frame("A15_grouped_bits_per_byte", f"WITH {LOSSES} SELECT source, {near('sum(nats) / (ln(2) * sum(bytes))', 'bpb')} FROM loss JOIN documents ON loss.doc_id = documents.doc_id GROUP BY source")
def grouped_bits_per_byte(spark, sf_dir):
    return document_losses(spark, sf_dir).groupBy("source").agg(rounded("sum(s.nats) / (ln(2) * sum(s.bytes))", "bpb"))


@R.frame("A16_document_nats_and_bytes", f"WITH {LOSSES} SELECT doc_id, {near('sum(nats)', 'nats')}, {big('sum(bytes)', 'bytes')} FROM loss GROUP BY doc_id")
def document_nats(spark, sf_dir):
    return document_losses(spark, sf_dir).select("doc_id", rounded("s.nats", "nats"), "s.bytes")


@R.frame("A17_token_loss", f"WITH {LOSSES} SELECT {near('sum(nats) / count(*)', 'loss')}, {near('sum(nats) / (ln(2) * sum(bytes))', 'bpb')}, {near('CAST(sum(bytes) AS DOUBLE) / count(*)', 'bytes_per_token')} FROM loss WHERE bytes > 0")
def token_loss(spark, sf_dir):
    return document_losses(spark, sf_dir).agg(rounded("sum(s.nats) / sum(s.n)", "loss"), rounded("sum(s.nats) / (ln(2) * sum(s.bytes))", "bpb"), rounded("sum(s.bytes) / sum(s.n)", "bytes_per_token"))


@R.frame("A18_perplexity", f"WITH {LOSSES} SELECT doc_id, {near('exp(avg(nats))', 'perplexity')}, {near('sum(nats) / ln(2) / sum(bytes)', 'bpb')} FROM loss GROUP BY doc_id")
def perplexity(spark, sf_dir):
    return document_losses(spark, sf_dir).select("doc_id", rounded("exp(s.nats / s.n)", "perplexity"), rounded("s.nats / ln(2) / s.bytes", "bpb"))


@R.frame(
    "A19_token_weighted_mean",
    f"WITH {LOSSES}, w AS (SELECT doc_id, pos // 128 AS win, avg(nats) AS loss, count(*) AS n FROM loss GROUP BY doc_id, pos // 128) SELECT {near('sum(loss * n) / sum(n)', 'loss')}, {near('exp(sum(loss * n) / sum(n))', 'perplexity')}, {big('sum(n)', 'tokens')} FROM w",
)
def token_weighted_mean(spark, sf_dir):
    """A row for each window of 128 tokens, made where its document is."""
    nats = worded(spark, sf_dir).select(F.transform("w", _loss).alias("nats"))
    windows = nats.select(F.explode(V.blocks(F.col("nats"), 128)).alias("win")).select(V.mean(F.col("win")).alias("loss"), F.size("win").alias("n"))
    return windows.agg(rounded("sum(loss * n) / sum(n)", "loss"), rounded("exp(sum(loss * n) / sum(n))", "perplexity"), F.sum("n").cast("bigint").alias("tokens"))


@R.frame("A24_compression_ratio", f"WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) SELECT documents.doc_id, {near('CAST(strlen(text) AS DOUBLE) / n', 'bytes_per_token')} FROM documents JOIN n ON documents.doc_id = n.doc_id")
def compression_ratio(spark, sf_dir):
    return worded(spark, sf_dir).select("doc_id", rounded("text_bytes / size(w)", "bytes_per_token"))


@R.frame("E04_document_bits_per_byte", f"WITH {LOSSES} SELECT doc_id, {near('sum(nats) / (ln(2) * sum(bytes))', 'bpb')} FROM loss WHERE bytes > 0 GROUP BY doc_id")
def document_bits_per_byte(spark, sf_dir):
    return document_losses(spark, sf_dir).select("doc_id", rounded("s.nats / (ln(2) * s.bytes)", "bpb"))


@R.frame("M07_completion_log_prob", f"WITH {LOSSES} SELECT doc_id, {near('sum(CASE WHEN pos >= 4 THEN -nats ELSE 0 END)', 'log_prob')} FROM loss GROUP BY doc_id")
def completion_log_prob(spark, sf_dir):
    return document_losses(spark, sf_dir).select("doc_id", rounded("-s.later", "log_prob"))


@R.frame("W09_next_token", f"WITH {TOKENS}, nx AS (SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS target FROM tok) SELECT doc_id, {DUCK.pick('target IS NOT NULL')} AS pairs, {DUCK.pick('target = tok')} AS repeats FROM nx GROUP BY doc_id")
def next_token(spark, sf_dir):
    """Each token beside the next one."""
    shifted = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda x, y: F.when(x == y, 1).otherwise(0))
    same = F.aggregate(shifted, F.lit(0).cast("bigint"), lambda s, hit: s + hit)
    return worded(spark, sf_dir).select("doc_id", (F.size("w") - 1).cast("bigint").alias("pairs"), same.alias("repeats"))


# --- cells of a vector ------------------------------------------------------------------------------------------------


@R.frame("A33_group_norms", f"WITH {CELLS} SELECT label, {near('sqrt(sum(x * x))', 'norm')} FROM cell GROUP BY label")
def group_norms(spark, sf_dir):
    return vectors(spark, sf_dir).select("label", V.dot(F.col("v"), F.col("v")).alias("q")).groupBy("label").agg(rounded("sqrt(sum(q))", "norm"))


@R.frame(
    "A35_update_ratio",
    f"WITH {CELLS}, nx AS (SELECT vec_id, i, x AS before, x * (1 + (vec_id % 7) * 0.001) AS after FROM cell) SELECT vec_id, {near('sqrt(sum((after - before) * (after - before))) / sqrt(sum(before * before))', 'ratio')} FROM nx GROUP BY vec_id HAVING sum(before * before) > 0",
)
def update_ratio(spark, sf_dir):
    factor = 1 + (F.col("vec_id") % 7) * 0.001
    both = vectors(spark, sf_dir).select("vec_id", V.norm(F.transform("v", lambda x: x * factor - x)).alias("moved"), V.norm(F.col("v")).alias("size"))
    return both.where("size > 0").select("vec_id", rounded("moved / size", "ratio"))


@R.frame(
    "A37_expert_use",
    f"WITH {CELLS}, r AS (SELECT vec_id, i % 8 AS expert, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM cell), u AS (SELECT expert, count(*) AS n FROM r WHERE k <= 2 GROUP BY expert), e AS (SELECT DISTINCT i % 8 AS expert FROM cell) SELECT {big('e.expert', 'expert')}, {big('coalesce(n, 0)', 'n')} FROM e LEFT JOIN u ON e.expert = u.expert",
)
def expert_use(spark, sf_dir):
    """Two experts a vector; the choices are counted where they are made, and experts without any get 0."""
    chosen = vectors(spark, sf_dir).select(F.explode(F.slice(V.ranked(F.col("v")), 1, 2)).alias("r")).select((F.col("r.i") % EXPERTS).cast("bigint").alias("expert"))
    used = chosen.groupBy("expert").agg(F.count("*").alias("n"))
    return spark.range(EXPERTS).withColumnRenamed("id", "expert").join(used, "expert", "left").select("expert", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@R.frame("A39_entropy", f"WITH {SOFTMAX} SELECT vec_id, {near('-sum(p * ln(greatest(p, 1e-12)))', 'entropy')} FROM sm GROUP BY vec_id")
def entropy(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(V.entropy(V.softmax(F.col("v"))), "entropy"))


@R.frame("A40_quantisation_scales", f"WITH {CELLS} SELECT vec_id, {near('max(abs(x)) / 127', 'int8')}, {near('max(CASE WHEN i < 32 THEN abs(x) END) / 7', 'int4_low')}, {near('max(CASE WHEN i >= 32 THEN abs(x) END) / 7', 'int4_high')} FROM cell GROUP BY vec_id")
def quantisation_scales(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", rounded(V.peak(F.col("v")) / 127, "int8"), rounded(V.peak(F.slice("v", 1, 32)) / 7, "int4_low"), rounded(V.peak(F.slice("v", 33, 32)) / 7, "int4_high"))


@R.frame(
    "A41_reconstruction_error",
    f"WITH {CELLS}, q AS (SELECT vec_id, x, max(abs(x)) OVER (PARTITION BY vec_id) / 127 AS scale FROM cell), r AS (SELECT vec_id, x, greatest(-128, least(127, round_even(x / scale, 0))) * scale AS y FROM q) SELECT vec_id, {near('avg((x - y) * (x - y)) * 1e6', 'mse_e6')}, {near('max(abs(x - y))', 'worst')} FROM r GROUP BY vec_id",
)
def reconstruction_error(spark, sf_dir):
    scaled = vectors(spark, sf_dir).withColumn("scale", V.peak(F.col("v")) / 127)
    off = scaled.select("vec_id", F.zip_with("v", V.quantised(F.col("v"), F.col("scale"), -128, 127), lambda x, q: x - q * F.col("scale")).alias("off"))
    return off.select("vec_id", rounded(V.dot(F.col("off"), F.col("off")) / F.size("off") * 1e6, "mse_e6"), rounded(V.peak(F.col("off")), "worst"))


@R.frame(
    "A43_mergeable_softmax",
    f"WITH {CELLS}, blocks AS (SELECT vec_id, i // 16 AS block, max(x) AS m FROM cell GROUP BY vec_id, i // 16), st AS (SELECT c.vec_id, p.block, p.m, sum(exp(c.x - p.m)) AS l, sum(exp(c.x - p.m) * c.i) AS o FROM cell c JOIN blocks p ON c.vec_id = p.vec_id AND c.i // 16 = p.block GROUP BY c.vec_id, p.block, p.m), top AS (SELECT vec_id, max(m) AS mm FROM st GROUP BY vec_id) SELECT st.vec_id, {near('sum(o * exp(m - mm)) / sum(l * exp(m - mm))', 'value')} FROM st JOIN top ON st.vec_id = top.vec_id GROUP BY st.vec_id",
)
def mergeable_softmax(spark, sf_dir):
    """States of blocks of 16 cells, whose values are their places, merged into one."""
    places = F.transform("v", lambda x, i: i.cast("double"))
    states = F.zip_with(V.blocks(F.col("v"), 16), V.blocks(places, 16), V.softmax_state)
    return vectors(spark, sf_dir).select("vec_id", V.merged_states(states).alias("s")).select("vec_id", rounded("s.o / s.l", "value"))


@R.frame(
    "M10_speculative_acceptance",
    f"WITH {CELLS}, pq AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p, exp(-x) / sum(exp(-x)) OVER (PARTITION BY vec_id) AS q FROM cell), r AS (SELECT vec_id, i, p, q, greatest(0.0, p - q) AS res FROM pq) SELECT vec_id, {near('sum(q * least(1.0, p / q))', 'accepted')}, {near('max(res) / sum(res)', 'largest_residual')} FROM r GROUP BY vec_id",
)
def speculative_acceptance(spark, sf_dir):
    pq = vectors(spark, sf_dir).select("vec_id", V.softmax(F.col("v")).alias("p"), V.softmax(F.transform("v", lambda x: -x)).alias("q"))
    met = pq.select("vec_id", V.total(F.zip_with("p", "q", lambda p, q: q * F.least(F.lit(1.0), p / q))).alias("accepted"), F.zip_with("p", "q", lambda p, q: F.greatest(F.lit(0.0), p - q)).alias("res"))
    return met.select("vec_id", rounded("accepted", "accepted"), rounded(F.array_max("res") / V.total(F.col("res")), "largest_residual"))


@R.frame(
    "M14_rms_norm",
    f"WITH {CELLS}, n AS (SELECT vec_id, i, x, sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-5) AS rms, avg(x) OVER (PARTITION BY vec_id) AS mean, var_pop(x) OVER (PARTITION BY vec_id) AS var FROM cell) SELECT vec_id, {big('i', 'i')}, {near('x / rms', 'rms_norm')}, {near('(x - mean) / sqrt(var + 1e-5)', 'layer_norm')} FROM n",
)
def rms_norm(spark, sf_dir):
    sized = vectors(spark, sf_dir).withColumns({"rms": F.sqrt(V.dot(F.col("v"), F.col("v")) / F.size("v") + 1e-5), "mean": V.mean(F.col("v"))})
    centred = sized.withColumn("c", F.transform("v", lambda x: x - F.col("mean"))).withColumn("sd", F.sqrt(V.dot(F.col("c"), F.col("c")) / F.size("v") + 1e-5))
    out = centred.select("vec_id", F.transform("v", lambda x: x / F.col("rms")).alias("rms_norm"), F.transform("c", lambda x: x / F.col("sd")).alias("layer_norm"))
    return by_cell(out, "rms_norm", "layer_norm").select("vec_id", "i", rounded("rms_norm", "rms_norm"), rounded("layer_norm", "layer_norm"))


@R.frame(
    "M16_router_fusion",
    f"WITH {CELLS}, w AS (SELECT vec_id, i // 16 AS expert, avg(x) AS loss FROM cell GROUP BY vec_id, i // 16), s AS (SELECT vec_id, expert, exp(-loss / 0.5) / sum(exp(-loss / 0.5)) OVER (PARTITION BY vec_id) AS p FROM w) SELECT cell.vec_id, {near('sum(p * x)', 'fused')} FROM cell JOIN s ON cell.vec_id = s.vec_id AND cell.i // 16 = s.expert GROUP BY cell.vec_id",
)
def router_fusion(spark, sf_dir):
    experts = vectors(spark, sf_dir).select("vec_id", V.blocks(F.col("v"), 16).alias("b"))
    weighed = experts.select("vec_id", F.transform("b", V.total).alias("sums"), V.softmax(F.transform("b", lambda x: V.mean(x) / -0.5)).alias("p"))
    return weighed.select("vec_id", rounded(V.dot(F.col("p"), F.col("sums")), "fused"))


@R.frame("W13_softmax", f"WITH {SOFTMAX} SELECT vec_id, {big('i', 'i')}, {near('p', 'p')} FROM sm")
def softmax_cells(spark, sf_dir):
    return by_cell(vectors(spark, sf_dir).select("vec_id", V.softmax(F.col("v")).alias("p")), "p").select("vec_id", "i", rounded("p", "p"))


@R.frame(
    "W14_online_softmax",
    f"WITH {CELLS}, r AS (SELECT vec_id, i, x, max(x) OVER (PARTITION BY vec_id ORDER BY i) AS m, max(x) OVER (PARTITION BY vec_id) AS top FROM cell) SELECT vec_id, {near('sum(exp(x - m) * exp(m - top))', 'denominator')} FROM r GROUP BY vec_id",
)
def online_softmax(spark, sf_dir):
    """One fold: the sum so far is scaled whenever a greater value comes."""
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("l"))

    def step(s, x):
        return V.let(F.greatest(s["m"], x), lambda m: F.struct(m.alias("m"), (s["l"] * F.exp(s["m"] - m) + F.exp(x - m)).alias("l")))

    return vectors(spark, sf_dir).select("vec_id", F.aggregate("v", start, step).alias("s")).select("vec_id", rounded("s.l", "denominator"))


@R.frame(
    "W15_causal_attention",
    f"WITH {CELLS}, c AS (SELECT vec_id, i, x FROM cell), a AS (SELECT q.vec_id, q.i, k.i AS j, q.x * k.x AS s, k.x AS v FROM c q JOIN c k ON q.vec_id = k.vec_id AND k.i <= q.i), m AS (SELECT vec_id, i, max(s) AS m FROM a GROUP BY vec_id, i) SELECT a.vec_id, {big('a.i', 'i')}, {near('sum(exp(s - m) * v) / sum(exp(s - m))', 'out')} FROM a JOIN m ON a.vec_id = m.vec_id AND a.i = m.i GROUP BY a.vec_id, a.i",
)
def causal_attention(spark, sf_dir):
    return by_cell(vectors(spark, sf_dir).select("vec_id", V.causal_attention(F.col("v")).alias("out")), "out").select("vec_id", "i", rounded("out", "out"))


@R.frame(
    "W17_nucleus",
    f"WITH {SOFTMAX}, c AS (SELECT vec_id, i, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS before FROM sm) SELECT vec_id, {big('count(*)', 'kept')}, {near('sum(p)', 'mass')} FROM c WHERE before < 0.8999995 GROUP BY vec_id",
)
def nucleus(spark, sf_dir):
    kept = vectors(spark, sf_dir).select("vec_id", V.nucleus(V.softmax(F.col("v")), 0.8999995).alias("s"))
    return kept.select("vec_id", "s.kept", rounded("s.mass", "mass"))


@R.frame("O07_top_two_renormalised", f"WITH {SOFTMAX}, r AS (SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS k FROM sm) SELECT vec_id, {big('i', 'i')}, {near('p / sum(p) OVER (PARTITION BY vec_id)', 'w')} FROM r WHERE k <= 2")
def top_two(spark, sf_dir):
    two = vectors(spark, sf_dir).select("vec_id", F.slice(V.ranked(V.softmax(F.col("v"))), 1, 2).alias("r"))
    weighed = two.select("vec_id", "r", F.aggregate("r", F.lit(0.0), lambda s, e: s + e["x"]).alias("t"))
    return weighed.select("vec_id", "t", F.explode("r").alias("e")).select("vec_id", F.col("e.i").cast("bigint").alias("i"), rounded("e.x / t", "w"))


_OPTIONS = f"WITH {CELLS}, opt AS (SELECT vec_id, label, i // 16 AS i, sum(x) AS x FROM cell GROUP BY vec_id, label, i // 16), r AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM opt)"


def _picked(spark, sf_dir) -> DataFrame:
    """The option, of runs of 16 cells, with the greatest sum."""
    sums = vectors(spark, sf_dir).select("vec_id", "label", F.transform(V.blocks(F.col("v"), 16), V.total).alias("x"))
    return sums.select("vec_id", "label", V.argmax(F.col("x")).cast("bigint").alias("pick"))


@R.frame("O13_argmax_option", f"{_OPTIONS} SELECT vec_id, {big('i', 'pick')}, i = label % 4 AS correct FROM r WHERE k = 1")
def argmax_option(spark, sf_dir):
    return _picked(spark, sf_dir).select("vec_id", "pick", (F.col("pick") == F.col("label") % 4).alias("correct"))


@R.frame("E01_multiple_choice", f"{_OPTIONS} SELECT label, {near('avg(CASE WHEN i = label % 4 THEN 1 ELSE 0 END)', 'accuracy')}, {big('count(*)', 'n')} FROM r WHERE k = 1 GROUP BY label")
def multiple_choice(spark, sf_dir):
    return _picked(spark, sf_dir).groupBy("label").agg(rounded("avg(CASE WHEN pick = label % 4 THEN 1 ELSE 0 END)", "accuracy"), F.count("*").alias("n"))


@R.frame("J19_page_table_gather", f"WITH {CELLS}, pt AS (SELECT DISTINCT vec_id, i // 16 AS block, (vec_id * 7 + i // 16 * 3) % 97 AS page FROM cell) SELECT cell.vec_id, {big('cell.i', 'i')}, {big('page', 'page')}, {big('cell.i % 16', 'slot')} FROM cell JOIN pt ON cell.vec_id = pt.vec_id AND cell.i // 16 = pt.block")
def page_table_gather(spark, sf_dir):
    """Each vector's own page table, gathered from at every place."""
    tabled = vectors(spark, sf_dir).select("vec_id", F.size("v").alias("n"), F.transform(V.blocks(F.col("v"), 16), lambda b, k: (F.col("vec_id") * 7 + k * 3) % 97).alias("pages"))
    placed = tabled.select("vec_id", "pages", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return placed.select("vec_id", F.col("i").cast("bigint").alias("i"), F.expr("pages[i div 16]").cast("bigint").alias("page"), (F.col("i") % 16).cast("bigint").alias("slot"))
