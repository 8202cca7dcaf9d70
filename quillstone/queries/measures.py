"""Aggregates, windows, ranks, joins and set operations written once for both engines (inventory 2.4-2.8)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.functions.text import hash32, normalized_words
from quillstone.operators import checks, contamination, grams, moments, overlap, ranks, shards
from quillstone.plans.dialect import DUCK, SPARK, SparkSql
from quillstone.plans.store import small_batches, written
from quillstone.queries.registry import Registry
from quillstone.sources.tables import table

R = Registry()


def big(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def near(x: str, name: str) -> str:
    """Six decimals; adding zero makes a negative zero plain."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0e0 AS {name}"


def tokens(d: SparkSql) -> str:
    """tok(doc_id, pos, tok): normalised words of all documents by position."""
    words = d.words("coalesce(text, '')")
    return f"tok AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, tok FROM {d.rows(f'(SELECT doc_id, {words} AS w FROM documents)', 'w', 'pos', 'tok')})"


def losses(d: SparkSql) -> str:
    """loss(doc_id, pos, nats, bytes): stand-in token losses, from a digest of word and place."""
    key = d.h32("concat(tok, '/', CAST(pos AS STRING))" if d.engine == "spark" else "tok || '/' || CAST(pos AS VARCHAR)")
    return f"{tokens(d)}, loss AS (SELECT doc_id, pos, tok, CAST({key} % 1000 AS DOUBLE) / 250 AS nats, {d.bytes('tok')} AS bytes FROM tok)"


def cells(d: SparkSql) -> str:
    """cell(vec_id, label, i, x): embeddings in long form."""
    return f"cell AS (SELECT vec_id, label, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x FROM {d.rows('(SELECT vec_id, label, embedding FROM embeddings)', 'embedding', 'i', 'x')})"


def scored(d: SparkSql) -> str:
    """s(prompt, idx, score, answer): completions with scores, from events by user."""
    return "s AS (SELECT user_id AS prompt, event_id AS idx, value AS score, event_type AS answer FROM events)"


def sql(name: str):
    def register(build):
        R.sql(name, build)
        return build

    return register


# --- aggregates -------------------------------------------------------------------------------------------------------


@sql("A01_token_counts")
def _(d):
    return f"WITH {tokens(d)} SELECT tok, {big('count(*)', 'n')} FROM tok GROUP BY tok"


def _by_id(spark, sf_dir, text, kernel):
    """``kernel`` of the documents whose id is theirs alone; the SQL, which puts rows of one id together, of the others."""
    docs = table(spark, sf_dir, "documents")
    shared = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared_ids")
    null = docs.where("doc_id is null")
    if not shared.count() and null.isEmpty():
        return kernel(docs)
    alone = docs.where("doc_id is not null").join(shared, "doc_id", "left_anti")
    others = docs.join(shared, "doc_id", "left_semi").unionByName(null)
    return kernel(alone).unionByName(spark.sql(text.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents} AS documents"), documents=others))


def _repetition(d):
    words = d.words("coalesce(text, '')")
    return f"WITH w AS (SELECT doc_id, {words} AS w FROM documents), g AS (SELECT doc_id, {d.grams('w', 5)} AS g FROM w), c AS (SELECT doc_id, gram, count(*) AS c FROM {d.rows('g', 'g', 'p', 'gram')} GROUP BY doc_id, gram), r AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS k, sum(c) AS n FROM c GROUP BY doc_id) SELECT w.doc_id, {near('coalesce(CAST(k AS DOUBLE) / n, 0.0)', 'repetition')} FROM w LEFT JOIN r ON w.doc_id = r.doc_id"


@R.frame("A02_repetition", _repetition(DUCK))
def repetition(spark, sf_dir):
    """Grams are named and sorted within their row; nothing is shuffled but ids."""
    share = F.expr(near("CASE WHEN grams > 0 THEN CAST(repeated AS DOUBLE) / grams ELSE 0D END", "repetition"))
    return _by_id(spark, sf_dir, _repetition(SPARK), lambda docs: grams.counts_by_id(docs, normalized_words(F.coalesce("text", F.lit(""))), 5).select("doc_id", share))


def pairs(d: SparkSql) -> str:
    """ch(w, p, c) over distinct words with a sentinel at both ends, and pair counts."""
    return f"{tokens(d)}, vocab AS (SELECT DISTINCT tok FROM tok), spelt AS (SELECT tok, {d.chars(_cat(d, chr(39) + '.' + chr(39), 'tok', chr(39) + '.' + chr(39)))} AS cs FROM vocab), ch AS (SELECT tok, p, c FROM {d.rows('spelt', 'cs', 'p', 'c')} WHERE c <> ''), nx AS (SELECT c AS a, lead(c) OVER (PARTITION BY tok ORDER BY p) AS b FROM ch), n AS (SELECT a, b, count(*) AS n FROM nx WHERE b IS NOT NULL GROUP BY a, b)"


def _cat(d: SparkSql, *parts: str) -> str:
    return " || ".join(parts)


@sql("A03_bigram_counts")
def _(d):
    return f"WITH {pairs(d)} SELECT a, b, {big('n', 'n')} FROM n"


SMOOTH = "al AS (SELECT DISTINCT c FROM ch), grid AS (SELECT x.c AS a, y.c AS b FROM al x CROSS JOIN al y), sm AS (SELECT grid.a, grid.b, coalesce(n, 0) + 1 AS k FROM grid LEFT JOIN n ON grid.a = n.a AND grid.b = n.b), pr AS (SELECT a, b, k, CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY a) AS p FROM sm)"


@sql("A04_smoothed_bigrams")
def _(d):
    return f"WITH {pairs(d)}, {SMOOTH} SELECT a, b, {near('p', 'p')} FROM pr"


@sql("A05_bigram_nll")
def _(d):
    return f"WITH {pairs(d)}, {SMOOTH} SELECT {near('-sum(n.n * ln(p)) / sum(n.n)', 'nll')}, {big('sum(n.n)', 'pairs')} FROM n JOIN pr ON n.a = pr.a AND n.b = pr.b"


@sql("A20_mean_and_standard_error")
def _(d):
    return f"SELECT event_type, {near('avg(value)', 'mean')}, {near('stddev_samp(value)', 'std')}, {near('stddev_samp(value) / sqrt(count(*))', 'se')} FROM events GROUP BY event_type"


@sql("A20_paired_difference")
def _(d):
    return f"WITH u AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS a, avg(CASE WHEN event_type = 'purchase' THEN value END) AS b FROM events GROUP BY user_id) SELECT {near('avg(a - b)', 'mean')}, {near('stddev_samp(a - b) / sqrt(count(a - b))', 'se')}, {big('count(a - b)', 'n')} FROM u"


@R.frame("A21_percentiles", f"SELECT event_type, {near(DUCK.quantile('value', 0.5), 'p50')}, {near(DUCK.quantile('value', 0.99), 'p99')} FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    out = ranks.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})
    return out.select("event_type", *[F.expr(near(c, c)) for c in ("p50", "p99")])


@R.frame("A22_upper_median", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value AS upper_median FROM r WHERE k = n // 2 + 1")
def upper_median(spark, sf_dir):
    return ranks.values_at_ranks(table(spark, sf_dir, "events"), ["user_id"], "value", {"upper_median": "n div 2"}).drop("n")


@sql("A23_rare_tokens")
def _(d):
    return f"WITH {tokens(d)}, c AS (SELECT tok, count(*) AS c FROM tok GROUP BY tok) SELECT {near('avg(CASE WHEN c < 5 THEN 1 ELSE 0 END)', 'below_five')}, {near('avg(CASE WHEN c = 1 THEN 1 ELSE 0 END)', 'single')}, {big('count(*)', 'vocabulary')} FROM c"


@sql("A25_distinct_and_repeated_grams")
def _(d):
    words = d.words("coalesce(text, '')")
    out = ", ".join(f"{near(f'CAST({d.size(d.distinct(f"g{n}"))} AS DOUBLE) / nullif({d.size(f"g{n}")}, 0)', f'distinct_{n}')}, {near(f'1 - CAST({d.size(d.distinct(f"g{n}"))} AS DOUBLE) / nullif({d.size(f"g{n}")}, 0)', f'repeated_{n}')}" for n in (2, 3, 4))
    return f"WITH w AS (SELECT doc_id, {words} AS w FROM documents), g AS (SELECT doc_id, {', '.join(f'{d.grams("w", n)} AS g{n}' for n in (2, 3, 4))} FROM w) SELECT doc_id, {out} FROM g"


@sql("A26_group_means")
def _(d):
    return f"SELECT lang, {near('avg(n_chars)', 'chars')}, {near('avg(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)', 'long_share')}, {big('count(*)', 'docs')} FROM documents GROUP BY lang"


@sql("A27_win_shares")
def _(d):
    return f"WITH p AS (SELECT prompt, max(CASE WHEN answer = 'click' THEN score END) AS a, max(CASE WHEN answer = 'view' THEN score END) AS b FROM ({scored(d)[6:-1]}) s GROUP BY prompt) SELECT {d.pick('a > b')} AS wins, {d.pick('a < b')} AS losses, {d.pick('a = b')} AS ties, {near('CAST(sum(CASE WHEN a > b THEN 2 WHEN a = b THEN 1 ELSE 0 END) AS DOUBLE) / (2 * nullif(count(a + b), 0))', 'win_share')} FROM p WHERE a IS NOT NULL AND b IS NOT NULL"


@sql("A28_majority_vote")
def _(d):
    return f"WITH {scored(d)}, v AS (SELECT prompt, answer, count(*) AS n, min(idx) AS first FROM s WHERE answer IS NOT NULL GROUP BY prompt, answer), r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, first) AS k FROM v) SELECT prompt, answer, {big('n', 'votes')} FROM r WHERE k = 1"


@sql("A29_most_common")
def _(d):
    place = "struct(doc_id, pos)" if d.engine == "spark" else "{'d': doc_id, 'p': pos}"
    return f"WITH {tokens(d)}, c AS (SELECT tok, count(*) AS n, min({place}) AS first FROM tok GROUP BY tok) SELECT tok, {big('n', 'n')} FROM c ORDER BY n DESC, first LIMIT 8"


@sql("A30_success_rate")
def _(d):
    return f"WITH {scored(d)} SELECT prompt, {near('avg(CASE WHEN ' + d.same('answer', chr(39) + 'click' + chr(39)) + ' THEN 1 ELSE 0 END)', 'rate')} FROM s GROUP BY prompt"


@sql("A31_power_law_fit")
def _(d):
    return f"WITH p AS (SELECT ln(p_size) AS x, ln(p_retailprice) AS y FROM part WHERE p_size > 0 AND p_retailprice > 0) SELECT {near('exp(regr_intercept(y, x))', 'a')}, {near('-regr_slope(y, x)', 'b')} FROM p"


@sql("A34_activation_profile")
def _(d):
    return f"WITH {cells(d)} SELECT {big('i', 'i')}, {near('avg(x)', 'mean')}, {near('stddev_samp(x)', 'std')}, {near('min(x)', 'low')}, {near('max(x)', 'high')}, {near('max(abs(x))', 'abs_max')} FROM cell GROUP BY i"


@sql("A36_scale_drops")
def _(d):
    return f"WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, {d.pick('value < before')} AS drops FROM p GROUP BY user_id"


def _balance_by_cells(d: SparkSql) -> str:
    return f"WITH {cells(d)}, x8 AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM cell), e AS (SELECT i, avg(p) AS importance, avg(CASE WHEN k <= 2 THEN 1 ELSE 0 END) AS load FROM x8 GROUP BY i) SELECT {near('count(*) * sum(importance * load)', 'loss')} FROM e"


@R.frame("A38_balance_loss", _balance_by_cells(DUCK))
def balance_loss(spark, sf_dir):
    each = moments.routing(table(spark, sf_dir, "embeddings"), "embedding", 64, 2)
    return each.agg(F.expr("count(*) * sum(importance * load)").alias("loss")).select(F.expr(near("loss", "loss")))


def softmax(d: SparkSql) -> str:
    return f"{cells(d)}, m AS (SELECT vec_id, label, i, x, max(x) OVER (PARTITION BY vec_id) AS top FROM cell), sm AS (SELECT vec_id, label, i, x, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY vec_id) AS p FROM m)"


def _cka_by_joins(d: SparkSql) -> str:
    return f"WITH {cells(d)}, z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM cell), a AS (SELECT vec_id, i, x FROM z WHERE i < 32), b AS (SELECT vec_id, i, x FROM z WHERE i >= 32), ab AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS g FROM a JOIN b ON a.vec_id = b.vec_id GROUP BY a.i, b.i), aa AS (SELECT a.i, c.i AS j, sum(a.x * c.x) AS g FROM a JOIN a c ON a.vec_id = c.vec_id GROUP BY a.i, c.i), bb AS (SELECT b.i, c.i AS j, sum(b.x * c.x) AS g FROM b JOIN b c ON b.vec_id = c.vec_id GROUP BY b.i, c.i) SELECT {near('(SELECT sum(g * g) FROM ab) / sqrt((SELECT sum(g * g) FROM aa) * (SELECT sum(g * g) FROM bb))', 'cka')}"


@R.frame("A42_linear_cka", _cka_by_joins(DUCK))
def linear_cka(spark, sf_dir):
    """The first 32 dimensions against the last 32."""
    return moments.linear_cka(table(spark, sf_dir, "embeddings"), "embedding", 64, 32).select(F.expr(near("cka", "cka")))


@sql("A45_difference_in_differences")
def _(d):
    return f"WITH g AS (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS run, avg(n_chars) AS m FROM documents GROUP BY lang, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END), p AS (SELECT lang, max(CASE WHEN run = 'a' THEN m END) - max(CASE WHEN run = 'b' THEN m END) AS d FROM g GROUP BY lang) SELECT x.lang, {near('x.d - y.d', 'did')} FROM p x CROSS JOIN p y WHERE y.lang = 'en' AND x.lang <> 'en'"


@R.frame("A46_median", f"SELECT source, {near(DUCK.quantile('n_chars', 0.5), 'median')} FROM documents GROUP BY source")
def median(spark, sf_dir):
    return ranks.quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", {"median": 0.5}).select("source", F.expr(near("median", "median")))


@sql("A48_best_so_far")
def _(d):
    return "SELECT event_id, user_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events"


@sql("A49_sampled_window_loss")
def _(d):
    pick = d.h32("concat('w', CAST(doc_id AS STRING))" if d.engine == "spark" else "'w' || CAST(doc_id AS VARCHAR)")
    return f"WITH {losses(d)}, w AS (SELECT doc_id, CASE WHEN {pick} % 10 = 0 THEN 'val' ELSE 'train' END AS split, avg(nats) AS loss FROM loss GROUP BY doc_id) SELECT split, {near('avg(loss)', 'loss')}, {near('exp(avg(loss))', 'perplexity')} FROM w GROUP BY split"


@R.frame("A50_timing_rates", f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events) SELECT event_type, {near('count(*) / sum(value)', 'rate')} FROM r WHERE run > 3 GROUP BY event_type")
def timing_rates(spark, sf_dir):
    """All runs less the first three, which every task narrows down to three before they meet."""
    events = table(spark, sf_dir, "events")
    runs = events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    warm = events.withColumn("run", F.expr("row_number() OVER (PARTITION BY event_type ORDER BY event_id)")).where("run <= 3")
    warm = warm.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("few"), F.sum("value").alias("part"))
    return runs.join(warm, F.col("event_type").eqNullSafe(F.col("kind"))).where("n > few").select("event_type", F.expr(near("(n - few) / (total - part)", "rate")))


@sql("A44_kept_and_dropped")
def _(d):
    return f"SELECT source, {d.pick('quality = 1')} AS kept, {d.pick('quality = 0')} AS dropped, {big('sum(n_chars)', 'chars')} FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source"


@sql("A07_group_numbers")
def _(d):
    return f"SELECT doc_id, {big('dense_rank() OVER (ORDER BY source, lang) - 1', 'group_no')}, {big('count(*) OVER (PARTITION BY source, lang)', 'group_size')} FROM documents" if d.engine != "spark" else f"SELECT doc_id, {big('g.group_no', 'group_no')}, {big('g.n', 'group_size')} FROM documents JOIN (SELECT source, lang, n, dense_rank() OVER (ORDER BY source, lang) - 1 AS group_no FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)) g ON documents.source = g.source AND documents.lang = g.lang"


# --- windows ----------------------------------------------------------------------------------------------------------


def _shingles(d):
    words = d.words("coalesce(text, '')")
    return f"WITH g AS (SELECT doc_id, {d.grams('w', 5)} AS g FROM (SELECT doc_id, {words} AS w FROM documents) q) SELECT doc_id, {big('count(*)', 'grams')}, {big('count(DISTINCT gram)', 'unique_grams')} FROM {d.rows('g', 'g', 'p', 'gram')} GROUP BY doc_id"


@R.frame("W01_shingles", _shingles(DUCK))
def shingles(spark, sf_dir):
    """Grams are named and counted within their row; nothing is shuffled but ids."""

    def counts(docs):
        c = grams.counts_by_id(docs, normalized_words(F.coalesce("text", F.lit(""))), 5).where("grams > 0")
        return c.select("doc_id", "grams", F.col("different").alias("unique_grams"))

    return _by_id(spark, sf_dir, _shingles(SPARK), counts)


@sql("W02_adjacent_pairs")
def _(d):
    words = d.words("coalesce(text, '')")
    return f"WITH g AS (SELECT doc_id, {d.grams('w', 2)} AS g FROM (SELECT doc_id, {words} AS w FROM documents) q), c AS (SELECT gram, count(*) AS n FROM {d.rows('g', 'g', 'p', 'gram')} GROUP BY gram) SELECT split_part(gram, ' ', 1) AS a, split_part(gram, ' ', 2) AS b, {big('n', 'n')} FROM c"


STREAM = "sized AS (SELECT doc_id, count(*) + 1 AS n FROM tok GROUP BY doc_id)"


def stream(d: SparkSql) -> str:
    """Documents laid end to end, an end token after each: first position of each."""
    return f"{tokens(d)}, {STREAM}, laid AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS at FROM sized)".replace(" AS at", " AS p0")


def _placed(spark, sf_dir):
    """Documents with words, laid end to end: first token and number of tokens, an end token each."""
    words = F.size(normalized_words(F.coalesce("text", F.lit(""))))
    sized = table(spark, sf_dir, "documents").select("doc_id", (words + 1).cast("bigint").alias("n_tokens")).where("n_tokens > 1")
    return shards.positions(sized).withColumn("first_token", F.col("first_token").cast("bigint"))


@R.frame("W03_document_of_token", f"WITH {stream(DUCK)} SELECT doc_id, {big('p0', 'first_token')}, {big('p0 + n - 1', 'end_token')} FROM laid")
def document_of_token(spark, sf_dir):
    return _placed(spark, sf_dir).select("doc_id", "first_token", (F.col("first_token") + F.col("n_tokens") - 1).alias("end_token"))


@R.frame("W05_fixed_windows", f"WITH {stream(DUCK)}, t AS (SELECT tok.doc_id, p0 + pos AS g, tok FROM tok JOIN laid ON tok.doc_id = laid.doc_id) SELECT {big('g // 1024', 'win')}, {big('count(*)', 'tokens')}, {big('count(DISTINCT doc_id)', 'docs')} FROM t GROUP BY g // 1024")
def fixed_windows(spark, sf_dir):
    """Each document is dealt to the windows that its words meet; no word becomes a row."""
    last = F.col("first_token") + F.col("n_tokens") - 2
    spread = _placed(spark, sf_dir).withColumn("last", last).withColumn("win", F.explode(F.sequence(F.expr("first_token div 1024"), F.expr("last div 1024"))))
    inside = F.least("last", F.col("win") * 1024 + 1023) - F.greatest("first_token", F.col("win") * 1024) + 1
    return spread.groupBy("win").agg(F.sum(inside).cast("bigint").alias("tokens"), F.count("*").alias("docs"))


@R.frame(
    "W05_lookahead_windows",
    f"""WITH tok AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, list_append({DUCK.words("coalesce(text, '')")}, '<end>') AS w FROM documents)),
    t AS (SELECT doc_id, tok, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM tok), n AS (SELECT count(*) // 10 AS v FROM tok),
    win AS (SELECT unnest(range((v - 1) // 256)) AS win FROM n), x AS (SELECT win, doc_id, g, tok FROM win JOIN t ON g BETWEEN win * 256 AND win * 256 + 256)
    SELECT {big('win', 'win')}, count(DISTINCT doc_id) AS docs, md5(string_agg(tok, ' ' ORDER BY g) FILTER (g < win * 256 + 256)) AS inputs, md5(string_agg(tok, ' ' ORDER BY g) FILTER (g > win * 256)) AS targets FROM x GROUP BY win""",
)
def lookahead_windows(spark, sf_dir):
    """Inputs and targets of the validation shard, which is the first tenth of all tokens."""
    words = F.concat(normalized_words(F.coalesce("text", F.lit(""))), F.array(F.lit("<end>")))
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("tokens"))
    every = docs.agg(F.sum(F.size("tokens")).alias("n")).first().n or 0
    out = shards.fixed_windows(docs, 256, every // 10)
    return out.select("win", "docs", *[F.md5(F.array_join(c, " ").cast("binary")).alias(name) for c, name in (("x", "inputs"), ("y", "targets"))])


@sql("W06_strided_windows")
def _(d):
    return f"WITH {stream(d)}, n AS (SELECT sum(n) AS n FROM sized) SELECT {big(d.div('n - 1', '1024'), 'windows')}, {big('n - 1024 * ' + d.div('n - 1', '1024'), 'tail')} FROM n"


@sql("W10_padded_contexts")
def _(d):
    return f"WITH {tokens(d)}, vocab AS (SELECT DISTINCT tok FROM tok), spelt AS (SELECT tok, {d.chars(_cat(d, chr(39) + '...' + chr(39), 'tok', chr(39) + '.' + chr(39)))} AS cs FROM vocab), ch AS (SELECT tok, p, c FROM {d.rows('spelt', 'cs', 'p', 'c')} WHERE c <> ''), cx AS (SELECT tok, c AS target, lag(c, 3) OVER w || lag(c, 2) OVER w || lag(c, 1) OVER w AS context FROM ch WINDOW w AS (PARTITION BY tok ORDER BY p)) SELECT context, target, {big('count(*)', 'n')} FROM cx WHERE context IS NOT NULL GROUP BY context, target"


def _covered_by_text(d: SparkSql) -> str:
    words = d.words("coalesce(text, '')")
    return f"WITH w AS (SELECT doc_id, {words} AS w FROM documents), g AS (SELECT doc_id, {d.grams('w', 20)} AS g FROM w), x AS (SELECT doc_id, p, gram FROM {d.rows('g', 'g', 'p', 'gram')}), c AS (SELECT gram, min(doc_id) AS first_doc FROM x GROUP BY gram), hit AS (SELECT doc_id, p FROM x JOIN c ON x.gram = c.gram WHERE doc_id <> first_doc), nxt AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hit), cov AS (SELECT doc_id, count(*) AS matches, sum(least(20, coalesce(q - p, 20))) AS covered FROM nxt GROUP BY doc_id) SELECT w.doc_id, {big('coalesce(matches, 0)', 'matches')}, {near('CASE WHEN ' + d.size('w') + ' > 0 THEN coalesce(covered, 0) / CAST(' + d.size('w') + ' AS DOUBLE) ELSE 0.0 END', 'covered')} FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id"


@R.frame("W12_covered_share", _covered_by_text(DUCK))
def covered_share(spark, sf_dir):
    out = overlap.shared_windows(table(spark, sf_dir, "documents"), normalized_words(F.col("text")))
    return out.select("doc_id", "matches", F.expr(near("CASE WHEN n_words > 0 THEN covered / CAST(n_words AS DOUBLE) ELSE 0D END", "covered")))


@sql("W16_group_centred_reward")
def _(d):
    return f"WITH {scored(d)} SELECT prompt, idx, {near('score - avg(score) OVER (PARTITION BY prompt) + 1e-9', 'advantage')} FROM s"


@sql("W19_changes")
def _(d):
    return f"SELECT event_id, user_id, {near('value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)', 'delta')}, value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS improves FROM events"


# --- ranks, limits ----------------------------------------------------------------------------------------------------


@sql("O02_largest_sources")
def _(d):
    return f"SELECT source, {big('count(*)', 'docs')} FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5"


@sql("O08_top_k_with_ties")
def _(d):
    return f"WITH {scored(d)}, r AS (SELECT prompt, idx, score, rank() OVER (PARTITION BY prompt ORDER BY score DESC) AS k FROM s) SELECT prompt, idx, score FROM r WHERE k <= 5"


@sql("O09_best_of_n")
def _(d):
    return f"WITH {scored(d)}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, idx) AS k FROM s) SELECT prompt, idx, score, answer FROM r WHERE k = 1"


@sql("O11_chosen_and_rejected")
def _(d):
    return f"WITH {scored(d)}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, idx) AS k, count(*) OVER (PARTITION BY prompt) AS n FROM s) SELECT prompt, max(CASE WHEN k = 1 THEN idx END) AS chosen, max(CASE WHEN k = n THEN idx END) AS rejected FROM r WHERE n > 1 GROUP BY prompt"


@sql("O12_commit_schedule")
def _(d):
    target = d.half_even("CAST(n AS DOUBLE) * (step + 1) / 8")
    before = d.half_even("CAST(n AS DOUBLE) * step / 8")
    return f"WITH {scored(d)}, r AS (SELECT prompt, idx, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, idx) AS k, count(*) OVER (PARTITION BY prompt) AS n FROM s), st AS (SELECT 0 AS step UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) SELECT prompt, idx, {big('step', 'step')} FROM r JOIN st ON k > {before} AND k <= {target}"


@R.frame("O15_seeded_shuffle", f"WITH k AS (SELECT doc_id, source, {DUCK.h32(chr(39) + '42/' + chr(39) + ' || CAST(doc_id AS VARCHAR)')} AS key FROM documents) SELECT doc_id, {big('row_number() OVER (PARTITION BY source ORDER BY key, doc_id)', 'place')}, key % 2 = 1 AS swapped FROM k")
def seeded_shuffle(spark, sf_dir):
    key = hash32(F.concat(F.lit("42/"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", key.alias("key"))
    return ranks.places(docs, ["source"], [F.col("key"), F.col("doc_id")]).select("doc_id", "place", (F.col("key") % 2 == 1).alias("swapped"))


@sql("O16_numeric_names")
def _(d):
    return f"SELECT DISTINCT source, {big('CAST(' + d.extract('source', '([0-9]+)$', 1) + ' AS BIGINT)', 'number')} FROM documents"


# --- joins ------------------------------------------------------------------------------------------------------------


@sql("J09_token_lengths")
def _(d):
    return f"WITH {tokens(d)}, v AS (SELECT DISTINCT tok, {d.bytes('tok')} AS bytes FROM tok) SELECT doc_id, {big('sum(bytes)', 'bytes')} FROM tok JOIN v ON tok.tok = v.tok GROUP BY doc_id"


@sql("J10_item_metadata")
def _(d):
    return "SELECT labels.doc_id, quality, toxic, source, lang FROM labels JOIN documents ON labels.doc_id = documents.doc_id"


@sql("J11_unblinded_ratings")
def _(d):
    return f"WITH {scored(d)}, k AS (SELECT prompt, CASE WHEN prompt % 2 = 0 THEN 'base' ELSE 'tuned' END AS a, CASE WHEN prompt % 2 = 0 THEN 'tuned' ELSE 'base' END AS b FROM s GROUP BY prompt), l AS (SELECT prompt, 'a' AS side, a AS checkpoint FROM k UNION ALL SELECT prompt, 'b', b FROM k) SELECT checkpoint, {big('count(*)', 'rated')}, {near('avg(score)', 'mean')} FROM s JOIN l ON s.prompt = l.prompt AND l.side = CASE WHEN s.idx % 2 = 0 THEN 'a' ELSE 'b' END GROUP BY checkpoint"


@R.frame(
    "J12_checked_pairs",
    f"WITH c AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS base, avg(value) FILTER (event_type = 'click') AS tuned FROM events GROUP BY user_id) SELECT user_id, {near('tuned - base', 'lead')} FROM c WHERE base IS NOT NULL AND tuned IS NOT NULL",
)
def checked_pairs(spark, sf_dir):
    """Users with both kinds, each kind once: a user with a cell missing or repeated would end the job."""
    cells = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").groupBy("user_id", "event_type").agg(F.avg("value").alias("v")).where("v is not null")
    both = cells.groupBy("user_id").agg(F.count("*").alias("n")).where("n = 2").select("user_id")
    pairs_ = checks.self_pivot(cells.join(both, "user_id", "left_semi"), ["user_id"], "event_type", ["view", "click"], "v")
    return pairs_.select("user_id", F.expr(near("click - `view`", "lead")))


@sql("J12_baseline_against_challengers")
def _(d):
    return f"WITH c AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY user_id, event_type) SELECT x.user_id, y.event_type AS challenger, {near('y.v - x.v', 'lead')} FROM c x JOIN c y ON x.user_id = y.user_id WHERE x.event_type = 'view' AND y.event_type <> 'view'"


@sql("J14_grid")
def _(d):
    return f"WITH l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents), c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) SELECT l.lang, s.source, {big('coalesce(n, 0)', 'n')} FROM l CROSS JOIN s LEFT JOIN c ON c.lang = l.lang AND c.source = s.source"


@sql("J16_contrast_pairs")
def _(d):
    return f"WITH r AS (SELECT source, lang, avg(n_chars) AS v FROM documents GROUP BY source, lang) SELECT a.source, {near('a.v - b.v', 'contrast')} FROM r a JOIN r b ON a.source = b.source WHERE a.lang = 'en' AND b.lang = 'fr'"


@sql("J17_not_seen")
def _(d):
    return "SELECT documents.doc_id FROM documents LEFT ANTI JOIN labels ON documents.doc_id = labels.doc_id" if d.engine == "spark" else "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)"


@sql("J18_lookup_with_default")
def _(d):
    return f"WITH {d.values('cap', 'code, caption', [('en', 'English'), ('de', 'German')])} SELECT doc_id, coalesce(caption, 'other') AS caption FROM documents LEFT JOIN cap ON lang = code"


# --- sets -------------------------------------------------------------------------------------------------------------


@sql("U01_distinct_union")
def _(d):
    return f"WITH {tokens(d)}, b AS (SELECT item_id, {d.words('text')} AS w FROM benchmark), bt AS (SELECT word FROM {d.rows('b', 'w', 'p', 'word')}) SELECT tok AS word FROM tok UNION SELECT word FROM bt"


@R.frame(
    "U01_distinct_grams",
    f"WITH v AS (SELECT doc_id, {DUCK.words("coalesce(text, '')")} AS w FROM documents), b AS (SELECT item_id, {DUCK.words("coalesce(text, '')")} AS w FROM benchmark), u AS (SELECT unnest({DUCK.grams('w', 13)}) AS gram FROM v UNION SELECT unnest({DUCK.grams('w', 13)}) FROM b) SELECT count(*) AS grams, CAST(sum(CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM u",
)
def distinct_grams(spark, sf_dir):
    """Grams of documents and items together, each once: a gram goes by the 128 bits of its MD5, whose first 32 are its digest."""
    words = F.array_join(normalized_words(F.coalesce("text", F.lit(""))), " ").alias("w")
    texts = table(spark, sf_dir, "documents").select(words).unionByName(table(spark, sf_dir, "benchmark").select(words))
    return _md5_names(texts, 13).distinct().agg(F.count("*").alias("grams"), F.sum(F.shiftrightunsigned("a", 32)).alias("digest"))


def _md5_names(texts, n):
    """(a, b): both halves of the MD5 of each run of n words; tasks drop the repeats within a batch."""
    small_batches(texts.sparkSession, 1000)

    def kernel(batches):
        md5 = hashlib.md5
        for batch in batches:
            met = set()
            for raw in batch.column(0).cast(pa.binary()):
                raw = raw.as_py()
                at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
                if len(at) >= n - 1:
                    met.update(md5(raw[i:j]).digest() for i, j in zip([0, *(at + 1).tolist()], [*at.tolist(), len(raw)][n - 1 :], strict=False))
            names = np.frombuffer(b"".join(met), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1])], names=["a", "b"])

    return texts.mapInArrow(kernel, "a bigint, b bigint")


@sql("U03_intersection")
def _(d):
    return f"WITH {tokens(d)}, b AS (SELECT item_id, {d.words('text')} AS w FROM benchmark), bt AS (SELECT word FROM {d.rows('b', 'w', 'p', 'word')}) SELECT tok AS word FROM tok INTERSECT SELECT word FROM bt"


@sql("U08_except")
def _(d):
    return f"WITH {tokens(d)}, b AS (SELECT item_id, {d.words('text')} AS w FROM benchmark), bt AS (SELECT word FROM {d.rows('b', 'w', 'p', 'word')}) SELECT word FROM bt EXCEPT SELECT tok FROM tok"


def _true_jaccard(d):
    words = d.words("coalesce(text, '')")
    return f"WITH g AS (SELECT doc_id, {d.distinct(d.grams('w', 5))} AS g FROM (SELECT doc_id, {words} AS w FROM documents) q), x AS (SELECT doc_id, gram FROM {d.rows('g', 'g', 'p', 'gram')}), f AS (SELECT gram, min(doc_id) AS m FROM x GROUP BY gram), i AS (SELECT x.doc_id, m, count(*) AS n FROM x JOIN f ON x.gram = f.gram WHERE x.doc_id > m GROUP BY x.doc_id, m) SELECT i.doc_id, i.m AS other, {near(f'CAST(n AS DOUBLE) / ({d.size("a.g")} + {d.size("b.g")} - n)', 'jaccard')} FROM i JOIN g a ON a.doc_id = i.doc_id JOIN g b ON b.doc_id = i.m"


@R.frame("U05_true_jaccard", _true_jaccard(DUCK))
def true_jaccard(spark, sf_dir):
    """Similarity to each first owner of a shared gram.

    Grams go by 96-bit names, packed by the task that they meet in.
    """
    words = normalized_words(F.coalesce("text", F.lit("")))
    return overlap.first_owner_jaccard(table(spark, sf_dir, "documents"), words, 5, F.octet_length("text")).select("doc_id", "other", F.expr(near("jaccard", "jaccard")))


@sql("U06_offset_union")
def _(d):
    return "SELECT doc_id, text FROM documents UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), text FROM benchmark"


@sql("U07_character_vocabulary")
def _(d):
    return f"WITH {tokens(d)}, v AS (SELECT DISTINCT tok FROM tok), s AS (SELECT {d.chars('tok')} AS cs FROM v), c AS (SELECT DISTINCT c FROM {d.rows('s', 'cs', 'p', 'c')} WHERE c <> '') SELECT c, {big('row_number() OVER (ORDER BY c)', 'id')} FROM c"
