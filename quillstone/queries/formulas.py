"""Scalar formulas, text functions, evaluation, preference and tool data (inventory 2.3, 2.9, 2.10, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import folded_words, normalized_words
from quillstone.operators import checks, judge, phrase_search
from quillstone.plans.dialect import DUCK, SparkSql
from quillstone.plans.store import folder
from quillstone.queries.measures import big, cells, losses, near, scored, tokens
from quillstone.queries.registry import Registry
from quillstone.sources.tables import table

R = Registry()


def sql(name: str):
    def register(build):
        R.sql(name, build)
        return build

    return register


def steps(d: SparkSql, n: int) -> str:
    """st(step): 0..n."""
    source = f"(SELECT {d.seq('0', str(n))} AS xs)" if d.engine == "spark" else f"(SELECT {d.seq('0', str(n))} AS xs)"
    return f"st AS (SELECT CAST(step AS BIGINT) AS step FROM {d.rows(source, 'xs', 'ip', 'step')})"


# --- mixing, schedules, scaling ---------------------------------------------------------------------------------------


@sql("M01_mixing_schedule")
def _(d):
    return f"WITH {steps(d, 1000)}, t AS (SELECT step, greatest(0.0, least(1.0, (CAST(step AS DOUBLE) / 1000 - 0.8) / 0.2)) AS u FROM st) SELECT step, {near('0.85 + u * (0.55 - 0.85)', 'web')}, {near('0.10 + u * (0.30 - 0.10)', 'code')}, {near('0.05 + u * (0.15 - 0.05)', 'math')} FROM t"


@sql("M03_learning_rate")
def _(d):
    return f"WITH {steps(d, 2000)} SELECT step, {near('CASE WHEN step < 100 THEN 3e-1 * (step + 1) / 100 WHEN step >= 2000 THEN 3e-2 ELSE 3e-2 + 0.5 * (3e-1 - 3e-2) * (1 + cos(pi() * (step - 100) / 1900.0)) END', 'lr')} FROM st"


@sql("M04_flops_and_hours")
def _(d):
    return f"WITH {steps(d, 24)}, m AS (SELECT step AS layers, 12 * step * 512.0 * 512 AS params FROM st WHERE step > 0) SELECT layers, {near('6 * params + 12 * layers * 512 * 1024.0', 'flops_per_token')}, {near('1e9 * (6 * params) / (0.3 * 312e12) / 3600', 'hours')} FROM m"


@sql("M05_inverted_power_law")
def _(d):
    return f"WITH {steps(d, 40)} SELECT step, {near('pow(2e1 / (2 + step * 5e-2), 1e0 / 3e-1)', 'tokens')} FROM st"


def pair_scores(d: SparkSql) -> str:
    """pr(prompt, c, r, cr, rr): log-probs of chosen and rejected, policy and reference."""
    return "pr AS (SELECT user_id AS prompt, -max(value) / 100 AS c, -min(value) / 90 - 1 AS r, -avg(value) / 100 AS cr, -avg(value) / 90 - 0.5 AS rr, count(*) AS n FROM events GROUP BY user_id)"


def _logsig(z: str) -> str:
    return f"(least({z}, 0) - ln(1 + exp(-abs({z}))))"


@sql("M06_preference_losses")
def _(d):
    dpo = _logsig("(0.1 * ((c - cr) - (r - rr)))")
    simpo = _logsig("(2.0 * (c / n - r / n) - 0.5)")
    odds = _logsig("((c - ln(1 - exp(least(c, -1e-6)))) - (r - ln(1 - exp(least(r, -1e-6)))))")
    return f"WITH {pair_scores(d)} SELECT prompt, {near('-' + dpo, 'dpo')}, {near('-' + simpo, 'simpo')}, {near('-c / n - 0.1 * ' + odds, 'orpo')}, {near('1 - 1 / (1 + exp(-0.1 * (c - cr)))', 'kto')} FROM pr"


@sql("M09_normalised_dot")
def _(d):
    v = d.vec("embedding")
    return f"WITH q AS (SELECT vec_id, {v} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt({d.dot('v', 'v')}) AS norm FROM q) SELECT vec_id, {near('norm', 'norm')}, {near(d.dot('v', 'v') + ' / (norm * norm)', 'self_cosine')} FROM n"


@sql("M11_int8_round_trip")
def _(d):
    return f"WITH {cells(d)} SELECT vec_id, {big('i', 'i')}, {big('greatest(-128, least(127, ' + d.half_even('x * 127') + '))', 'q')} FROM cell"


@sql("M15_needle_splice")
def _(d):
    words = d.words("coalesce(text, '')")
    cut = f"CAST(floor({d.size('w')} * 0.5) AS INT)"
    whole = d.cat(d.part("w", "1", cut), d.array("'needle'"), d.part("w", f"{cut} + 1", d.size("w")))
    return f"WITH b AS (SELECT doc_id, {words} AS w FROM documents) SELECT doc_id, md5({d.join(whole, ' ')}) AS digest FROM b"


@sql("M17_byte_lengths")
def _(d):
    return f"SELECT doc_id, {big(d.bytes('text'), 'bytes')}, {big('length(text)', 'chars')} FROM documents"


@sql("M18_pages_needed")
def _(d):
    return f"SELECT doc_id, {big('ceil(n_chars / 16.0)', 'pages')}, {big('n_chars % 16', 'tail')} FROM documents"


@sql("M19_repeated_heads")
def _(d):
    return f"WITH {cells(d)}, r AS (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) SELECT {big('i * 4 + k', 'head')}, {near('sum(x)', 'total')} FROM cell CROSS JOIN r GROUP BY i * 4 + k"


@sql("M21_masked_sequences")
def _(d):
    """The whole text as prefix, four blanks to fill, and where they stand (from 0)."""
    words = d.words("coalesce(text, '')")
    whole = d.cat(d.array("'[CLS]'"), "w", d.repeat("'[MASK]'", "4"), d.array("'[SEP]'"))
    return f"WITH b AS (SELECT doc_id, {words} AS w FROM documents) SELECT doc_id, md5({d.join(whole, ' ')}) AS masked, {big(d.size('w') + ' + 1', 'first_blank')}, {big(d.size('w') + ' + 4', 'last_blank')}, {big(d.size(whole), 'length')} FROM b"


@sql("M22_last_element")
def _(d):
    words = d.words("coalesce(text, '')")
    return f"WITH b AS (SELECT doc_id, {words} AS w FROM documents) SELECT doc_id, {d.last('w')} AS last_word FROM b"


# --- filters ----------------------------------------------------------------------------------------------------------


@sql("F03_flag_bits")
def _(d):
    bits = "CASE WHEN n_chars < 300 THEN 1 ELSE 0 END + CASE WHEN lang <> 'en' THEN 2 ELSE 0 END + CASE WHEN n_chars > 10000 THEN 4 ELSE 0 END"
    return f"WITH f AS (SELECT doc_id, {bits} AS b FROM documents) SELECT {d.pick('b & 1 = 1')} AS short, {d.pick('b & 2 = 2')} AS foreign_text, {d.pick('b & 4 = 4')} AS long FROM f"


@sql("F06_evidence_text")
def _(d):
    return "SELECT documents.doc_id, md5(CASE WHEN quality = 0 THEN text ELSE substr(text, 1, 300) END) AS evidence FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"


@R.frame(
    "F08_phrase_containment",
    f"""WITH p AS (SELECT item_id, {DUCK.words('text')} AS w FROM benchmark), t AS (SELECT doc_id, ' ' || array_to_string({DUCK.words("coalesce(text, '')")}, ' ') || ' ' AS body FROM documents),
    q AS (SELECT item_id, 'item' AS kind, w FROM p UNION ALL SELECT item_id, 'closing', w[-13:] FROM p UNION ALL SELECT item_id, 'opening', w[:3] FROM p)
    SELECT DISTINCT kind, item_id, doc_id FROM q JOIN t ON contains(body, ' ' || array_to_string(w, ' ') || ' ') WHERE len(w) > 0""",
)
def phrase_containment(spark, sf_dir):
    """Documents that hold an item as a whole, its last 13 words, or its first three."""
    words = normalized_words(F.col("text"))
    items = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", words.alias("w"))
    kinds = {"item": "w", "closing": "slice(w, greatest(1, size(w) - 12), 13)", "opening": "slice(w, 1, 3)"}
    phrases = [items.select(F.struct(F.lit(kind).alias("kind"), "item_id").alias("item"), F.expr(cut).alias("w")) for kind, cut in kinds.items()]
    phrases = phrases[0].unionByName(phrases[1]).unionByName(phrases[2])
    found = phrase_search.contained_phrases(table(spark, sf_dir, "documents"), phrases, words, F.col("w"), phrase_id="item")
    return found.select("item.kind", "item.item_id", "doc_id")


@sql("F09_present_keys")
def _(d):
    return f"SELECT event_type, {d.pick(d.json('props', 'k') + ' IS NOT NULL')} AS present FROM events GROUP BY event_type"


@sql("F10_text_targets")
def _(d):
    return f"WITH {losses(d)} SELECT {big('count(*)', 'targets')} FROM loss WHERE bytes > 0"


@sql("F11_length_gates")
def _(d):
    words = d.size(d.words("coalesce(text, '')"))
    return f"WITH n AS (SELECT {words} AS n FROM documents) SELECT {d.pick('n >= 5')} AS shingled, {d.pick('n >= 13')} AS checkable FROM n"


@sql("F13_clipped_curve")
def _(d):
    return f"SELECT event_id FROM events WHERE event_id <= (SELECT max(event_id) / 2 FROM events)"


@sql("F14_frozen_prefix")
def _(d):
    return f"WITH {cells(d)} SELECT DISTINCT {big('i', 'layer')}, i < floor(64 * 0.3) AS frozen FROM cell"


@sql("F15_decay_groups")
def _(d):
    return f"WITH {d.values('par', 'seq, name, kind, dims, object_id', [(1, 'wte.weight', 'embedding', 2, 10), (2, 'h0.attn.weight', 'linear', 2, 11), (3, 'h0.attn.bias', 'linear', 1, 12), (4, 'ln.weight', 'norm', 1, 13), (5, 'head.weight', 'linear', 2, 10)])}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS k FROM par) SELECT name, CASE WHEN kind = 'linear' AND name LIKE '%weight' AND dims >= 2 THEN 'decay' ELSE 'no_decay' END AS grp FROM r WHERE k = 1"


# --- text -------------------------------------------------------------------------------------------------------------


@sql("X04_lengths")
def _(d):
    w = d.words("coalesce(text, '')")
    return f"WITH b AS (SELECT doc_id, text, {w} AS w FROM documents) SELECT doc_id, {big('length(text)', 'chars')}, {big(d.size('w'), 'words')}, {near('CASE WHEN ' + d.size('w') + ' > 0 THEN CAST(length(' + d.join('w', '') + ') AS DOUBLE) / ' + d.size('w') + ' ELSE 0 END', 'mean_len')} FROM b"


@sql("X05_non_ascii_share")
def _(d):
    rest = d.replace_all("text", "[\\x00-\\x7F]", "")
    return f"SELECT doc_id, {near(f'CAST(length({rest}) AS DOUBLE) / greatest(length(text), 1)', 'share')} FROM documents"


@sql("X06_symbol_ratio")
def _(d):
    return f"WITH b AS (SELECT doc_id, {d.raw('text')} AS r FROM documents) SELECT doc_id, {near('CAST(' + d.size(d.kept('r', 'x', d.matches('x', '^(#|…|[.][.][.])'))) + ' AS DOUBLE) / greatest(' + d.size('r') + ', 1)', 'ratio')} FROM b"


@sql("X07_bullet_lines")
def _(d):
    return f"WITH b AS (SELECT doc_id, {d.kept(d.split('text', chr(10)), 'x', d.matches('x', '[^ ]'))} AS l FROM documents) SELECT doc_id, {near('CAST(' + d.size(d.kept('l', 'x', d.matches('x', '^ *[•*-]'))) + ' AS DOUBLE) / greatest(' + d.size('l') + ', 1)', 'share')} FROM b".replace(chr(10), "\\n")


@sql("X08_alpha_words")
def _(d):
    return f"WITH b AS (SELECT doc_id, {d.words('text')} AS w, {d.raw('text')} AS r FROM documents) SELECT doc_id, {near('CAST(' + d.size('w') + ' AS DOUBLE) / greatest(' + d.size('r') + ', 1)', 'share')} FROM b"


@sql("X10_last_number")
def _(d):
    return f"WITH b AS (SELECT doc_id, {d.match_all("replace(text, ',', '')", '-?[0-9]+[.]?[0-9]*')} AS n FROM documents) SELECT doc_id, {d.try_double(d.last('n'))} AS number FROM b"


@sql("X11_exact_and_substring")
def _(d):
    return f"WITH a AS (SELECT conv_id, turn, text AS user_text FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, text AS reply FROM conversations WHERE role = 'assistant') SELECT a.conv_id, a.turn, trim(user_text) = trim(reply) AS exact, length(trim(user_text)) > 0 AND instr(reply, trim(user_text)) > 0 AS inside FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"


@R.frame(
    "X12_casefolded_words",
    """WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(lower(text), chr(223), 'ss'), '[^\\pL\\pN_]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS words, md5(array_to_string(w, ' ')) AS digest FROM b""",
)
def casefolded_words(spark, sf_dir):
    """The oracle splits where this matches, and folds the one character of the tables that lower case leaves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", folded_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).cast("bigint").alias("words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@sql("X13_last_line_and_words")
def _(d):
    w = d.words("text")
    tail = d.join(d.part("w", f"greatest(1, {d.size('w')} - 12)", "13"), " ")
    return f"WITH b AS (SELECT item_id, text, {w} AS w FROM benchmark) SELECT item_id, {tail} AS tail FROM b"


@sql("X14_prompts")
def _(d):
    return "SELECT item_id, 'Question: ' || text || ' Choices: A, B, C, D. Answer:' AS prompt FROM benchmark"


@sql("X15_slugs")
def _(d):
    inner = d.replace_all("lower(p_name)", "[^a-z0-9]+", "-")
    return f"SELECT p_partkey, {d.replace_all(inner, '^-+|-+$', '')} AS slug FROM part"


@sql("X16_heading_split")
def _(d):
    return f"WITH l AS (SELECT doc_id, p, line FROM {d.rows('(SELECT doc_id, ' + d.split('text', '[\\n]') + ' AS ls FROM documents)', 'ls', 'p', 'line')}), s AS (SELECT doc_id, p, line, sum(CASE WHEN {d.matches('line', '^[A-Z]')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS section FROM l) SELECT doc_id, {big('section', 'section')}, {big('count(*)', 'n_lines')} FROM s GROUP BY doc_id, section"


@sql("X17_status")
def _(d):
    return f"WITH c AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source) SELECT source, CASE WHEN n = 0 THEN 'missing' WHEN langs < 4 THEN 'partial' ELSE 'complete' END AS status FROM c"


@sql("X18_header_fields")
def _(d):
    return f"WITH h AS (SELECT page_id, {d.split('url', '[?&]')} AS ps FROM pages), k AS (SELECT page_id, kv FROM {d.rows('h', 'ps', 'p', 'kv')}) SELECT page_id, lower(trim(substr(kv, 1, instr(kv, '=') - 1))) AS name, substr(kv, instr(kv, '=') + 1) AS value FROM k WHERE instr(kv, '=') > 1"


@sql("X19_truncated_chain")
def _(d):
    ls = d.split("text", "[\\n]")
    half = f"greatest(1, {d.div(d.size('ls'), '2')})"
    return f"WITH b AS (SELECT doc_id, {ls} AS ls FROM documents) SELECT doc_id, md5({d.join(d.part('ls', '1', half), ' ')}) AS digest FROM b"


@sql("X21_corruption")
def _(d):
    return "SELECT item_id, replace(replace(replace(text, 'the', 'teh'), '.', ''), ' a ', ' ') AS corrupted FROM benchmark"


@sql("X22_templates")
def _(d):
    return f"WITH {d.values('city', 'name, temp', [('Oslo', 3), ('Cairo', 31), ('Lima', 19)])} SELECT 'What is the weather in ' || name || '?' AS question, 'It is ' || CAST(temp AS {'STRING' if d.engine == 'spark' else 'VARCHAR'}) || ' degrees.' AS answer FROM city"


@sql("X24_opaque_ids")
def _(d):
    key = "concat('pair/', CAST(doc_id AS STRING))" if d.engine == "spark" else "'pair/' || CAST(doc_id AS VARCHAR)"
    return f"SELECT doc_id, substr({d.sha256(key)}, 1, 12) AS pair_id FROM documents"


@sql("X25_snippets")
def _(d):
    return "SELECT doc_id, substr(text, 1, 300) AS snippet, substr(text, 1, 1000) AS longer FROM documents"


@sql("T12_prefix_split")
def _(d):
    """The first nine tenths of the characters for training, the others for validation."""
    cut = d.div("length(text) * 9", "10")
    return f"SELECT doc_id, {big(cut, 'train_chars')}, md5(substr(text, 1, CAST({cut} AS INT))) AS train, md5(substr(text, CAST({cut} AS INT) + 1)) AS validation FROM documents"


@sql("T10_token_byte_table")
def _(d):
    return f"WITH {tokens(d)} SELECT DISTINCT tok, {big(d.bytes('tok'), 'bytes')} FROM tok"


@sql("T13_padded_targets")
def _(d):
    w = d.words("text")
    ids = d.each("w", "x", "CAST(length(x) AS INT)" if d.engine == "spark" else "CAST(length(x) AS INTEGER)")
    whole = d.cat(d.repeat("-100", "49"), ids)
    text = d.join(d.each("ids", "y", f"CAST(y AS {'STRING' if d.engine == 'spark' else 'VARCHAR'})"), ",")
    return f"WITH b AS (SELECT item_id, {w} AS w FROM benchmark), t AS (SELECT item_id, {whole} AS ids FROM b) SELECT item_id, md5({text}) AS target, {big(d.size('ids'), 'length')} FROM t"


# --- evaluation, preference, tools ------------------------------------------------------------------------------------


@sql("E02_open_ended")
def _(d):
    return f"WITH a AS (SELECT conv_id, turn, text AS t0 FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, text AS t1 FROM conversations WHERE role = 'assistant') SELECT {near('avg(CASE WHEN trim(t0) = trim(t1) THEN 1 ELSE 0 END)', 'exact')}, {near('avg(CASE WHEN length(trim(t0)) > 0 AND instr(t1, trim(t0)) > 0 THEN 1 ELSE 0 END)', 'inside')} FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"


@sql("E06_generation_summary")
def _(d):
    w = d.words("coalesce(text, '')")
    return f"WITH g AS (SELECT role, {d.grams('w', 2)} AS g FROM (SELECT role, {w} AS w FROM conversations) q) SELECT role, {near('avg(CAST(' + d.size(d.distinct('g')) + ' AS DOUBLE) / nullif(' + d.size('g') + ', 0))', 'distinct_2')}, {big('count(*)', 'n')} FROM g GROUP BY role"


@sql("G01_preference_pairs")
def _(d):
    return f"WITH {scored(d)}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, idx) AS k, count(*) OVER (PARTITION BY prompt) AS n FROM s) SELECT prompt, max(CASE WHEN k = 1 THEN answer END) AS chosen, max(CASE WHEN k = n THEN answer END) AS rejected FROM r WHERE n > 1 GROUP BY prompt"


@sql("G02_self_consistency")
def _(d):
    return f"WITH {scored(d)}, v AS (SELECT prompt, answer, count(*) AS n, min(idx) AS first, sum(score) AS total FROM s GROUP BY prompt, answer), r AS (SELECT prompt, answer, n, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, first) AS k, row_number() OVER (PARTITION BY prompt ORDER BY round(total, 6) DESC, first) AS kw FROM v) SELECT prompt, max(CASE WHEN k = 1 THEN answer END) AS majority, max(CASE WHEN kw = 1 THEN answer END) AS weighted FROM r GROUP BY prompt"


def actions(d: SparkSql) -> str:
    """act(id, text): tool-call texts made from events, some malformed."""
    text = "CASE WHEN event_id % 5 = 0 THEN 'no tool here' WHEN event_id % 7 = 0 THEN 'Action: {broken' ELSE 'Thought. Action: ' || props || ' done' END"
    return f"act AS (SELECT event_id AS id, {text} AS text FROM events)"


@sql("B01_parsed_actions")
def _(d):
    found = d.extract("text", "Action:[ ]*([{].*[}])", 1)
    value = d.json("a", "k") if d.engine == "spark" else "json_extract_string(nullif(a, ''), '$.k')"
    return f"WITH {actions(d)}, p AS (SELECT id, {found} AS a FROM act) SELECT id, {big('CAST(' + value + ' AS BIGINT)', 'k')} FROM p"


@sql("B03_judge_scores")
def _(d):
    t = "STRING" if d.engine == "spark" else "VARCHAR"
    return f"WITH j AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' ' || CAST(event_id % 11 AS {t}) || ' ' ELSE 'score: none' END AS said FROM events) SELECT event_id, {d.try_int('said')} AS score FROM j"


@sql("B05_interface_compliance")
def _(d):
    return f"WITH {d.values('want', 'field, expected', [('width', '512'), ('norm', 'rms'), ('vocab', '50257')])}, {d.values('have', 'field, actual', [('width', '512'), ('norm', 'layer')])} SELECT want.field, expected, actual FROM want LEFT JOIN have ON want.field = have.field WHERE NOT {d.same('expected', 'actual')}"


@sql("B07_structural_checks")
def _(d):
    return f"WITH {cells(d)} SELECT label, {d.pick('isnan(x)')} AS nans, {near('sqrt(avg(x * x))', 'rms')}, sqrt(avg(x * x)) > 0.1 AND sqrt(avg(x * x)) < 10 AS in_range FROM cell GROUP BY label"


@R.frame("B07_constrained_vectors", "SELECT label, count(*) AS vectors FROM embeddings WHERE embedding IS NOT NULL GROUP BY label")
def constrained_vectors(spark, sf_dir):
    """Vectors that all have 64 finite numbers and a root mean square within (0.1, 10); any other would end the job with its id."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("x", F.col("embedding").cast("array<double>"))
    rms = F.sqrt(F.expr("aggregate(x, 0D, (s, v) -> s + v * v)") / F.size("x"))
    rules = {"64 numbers": F.size("x") == 64, "finite": F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), "in range": (rms > 0.1) & (rms < 10)}
    return checks.constrained(rows, rules, ["vec_id"]).groupBy("label").agg(F.count("*").alias("vectors"))


def stand_in_judge(prompts: list[str]) -> list[str | None]:
    """A judge that needs no model: a score of 1 to 12 from the prompt's digest, or words instead of one in every seventh case."""
    import hashlib

    numbers = [int(hashlib.md5(p.encode()).hexdigest()[:8], 16) for p in prompts]
    return ["no score" if n % 7 == 0 else f" {1 + n % 12} " for n in numbers]


@R.frame(
    "E03_judged_replies",
    f"WITH j AS (SELECT conv_id, turn, 'Rate this reply from 1 to 10. Answer with the number only.' || chr(10) || chr(10) || coalesce(text, '') AS p FROM conversations WHERE role = 'assistant'), h AS (SELECT conv_id, turn, {DUCK.h32('p')} AS h FROM j) SELECT conv_id, turn, CAST(CASE WHEN h % 7 <> 0 AND 1 + h % 12 <= 10 THEN 1 + h % 12 END AS INTEGER) AS score FROM h",
)
def judged_replies(spark, sf_dir):
    """Equal replies are judged once; answers that are no number from 1 to 10 are null."""
    replies = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    prompt = F.concat(F.lit("Rate this reply from 1 to 10. Answer with the number only.\n\n"), F.col("text"))
    return judge.scores(judge.ask(replies, prompt, stand_in_judge, folder(spark, "answers"))).select("conv_id", "turn", "score")


@sql("V02_padding_waste")
def _(d):
    return f"WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations), b AS (SELECT {d.div('conv_id', '8')} AS batch, max(n) AS longest, count(*) AS k, sum(n) AS used FROM t GROUP BY {d.div('conv_id', '8')}) SELECT {big('batch', 'batch')}, {big('longest * k - used', 'wasted')} FROM b"


@sql("D15_token_id_overlap")
def _(d):
    w, b = d.words("coalesce(text, '')"), d.words("text")
    ids = lambda a: d.each(a, "x", f"CAST({d.h32('x')} AS {'STRING' if d.engine == 'spark' else 'VARCHAR'})")
    return f"WITH dw AS (SELECT doc_id, {ids('w')} AS w FROM (SELECT doc_id, {w} AS w FROM documents) q), dg AS (SELECT doc_id, {d.distinct(d.grams('w', 13))} AS g FROM dw), dx AS (SELECT doc_id, gram FROM {d.rows('dg', 'g', 'p', 'gram')}), bw AS (SELECT item_id, {ids('w')} AS w FROM (SELECT item_id, {b} AS w FROM benchmark) q), bg AS (SELECT {d.distinct(d.grams('w', 13))} AS g FROM bw), bx AS (SELECT DISTINCT gram FROM {d.rows('bg', 'g', 'p', 'gram')}) SELECT doc_id, {big('count(DISTINCT dx.gram)', 'overlap')} FROM dx JOIN bx ON dx.gram = bx.gram GROUP BY doc_id"


@sql("S03_bounded_scan")
def _(d):
    return "SELECT doc_id, lang, source FROM documents WHERE doc_id < 500"


@sql("S04_benchmark_sets")
def _(d):
    return "SELECT item_id, 'even' AS name, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'odd' AS name, text FROM benchmark WHERE item_id % 2 = 1"


@sql("S01_text_scan")
def _(d):
    return "SELECT text FROM documents"
