"""Chat formatting in budgeted, turn-aligned windows; DataFrame functions only.

One exchange on the conversation; prefix sums of turn tokens then choose the
windows, and everything after keeps that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
ROLE_END, TURN_END = "\n", END + "\n"
BUDGET, HISTORY = 512, 96
#: Tokens of a turn beside its text.
OVERHEAD = 4


def escape(text: Column) -> Column:
    """No control string is left: every ``<|`` becomes ``<\\|``, every backslash two."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and a line end, which ends roles, becomes ``\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undoes both: pairs of backslashes are set apart first, left to right."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def turn_tokens(text: Column) -> Column:
    """The built-in estimate: four bytes a token, and the turn's marks."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint") + OVERHEAD


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=turn_tokens, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of conversations: conv_id, ``win``, ``formatted``, ``loss``, ``n_turns``, ``n_repeated``, ``n_tokens``, ``over_budget``.

    A leading system turn opens every window.  Of the budget that it leaves,
    half of what is not kept for history is the stride: a turn belongs to
    window ``tokens before it div stride``.  A window thus holds less than a
    stride and its last turn, and fits the budget if no turn is longer than a
    stride; one that does not fit is marked, never cut.  Turns that begin
    within the history limit before a window's first are repeated in it.

    ``loss`` lists (start, length) in characters of ``formatted``: each
    assistant text once over all windows, repeats being masked.

    Turns are ordered by number (null first), then role and text; null roles
    and texts count as empty; repeated rows are turns of their own; a null
    conversation is one conversation; an empty table gives no rows; other
    columns are ignored.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    conv = Window.partitionBy("conv_id")
    ordered = conv.orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.select(
        "conv_id",
        "role",
        F.row_number().over(ordered).alias("pos"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit(ROLE_END)).alias("head"),
        escape(F.col("text")).alias("body"),
        tokens(F.col("text")).alias("n"),
        F.sum(tokens(F.col("text"))).over(so_far).alias("upto"),
        F.first(F.when(F.col("role") == "system", F.struct(F.concat(F.lit(START), escape_role(F.col("role")), F.lit(ROLE_END), escape(F.col("text")), F.lit(TURN_END)).alias("piece"), tokens(F.col("text")).alias("n")))).over(so_far).alias("system"),
    )
    lead = F.coalesce(F.col("system.n"), F.lit(0))
    t = t.withColumn("stride", F.greatest(F.lit(1), F.expr(f"({budget} - {history} - coalesce(system.n, 0)) div 2")))
    t = t.withColumn("at", F.when(F.col("system").isNotNull() & (F.col("pos") == 1), F.lit(-1)).otherwise(F.col("upto") - F.col("n") - lead))
    t = t.withColumn("win", F.expr("if(at < 0, 0, at div stride)"))
    following = conv.orderBy("win").rangeBetween(1, 1)
    t = t.withColumn("next_at", F.min("at").over(following))
    again = (F.col("at") >= 0) & (F.col("next_at") - F.col("at") <= F.least(F.lit(history), F.col("stride")))
    fresh, repeat = F.struct(F.col("win"), F.lit(False).alias("repeated")), F.struct((F.col("win") + 1).alias("win"), F.lit(True).alias("repeated"))
    t = t.select("conv_id", "pos", "role", "head", "body", "n", "system", F.inline(F.when(again, F.array(fresh, repeat)).otherwise(F.array(fresh))))
    before = Window.partitionBy("conv_id", "win").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(TURN_END)
    opens = F.when(F.col("win") > 0, F.coalesce(F.char_length("system.piece"), F.lit(0))).otherwise(F.lit(0))
    t = t.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)) + opens)
    taught = (F.col("role") == "assistant") & ~F.col("repeated")
    turn = F.struct(
        "pos",
        F.concat("head", "body", F.lit(TURN_END)).alias("piece"),
        "repeated",
        F.when(taught, F.struct((F.col("offset") + F.char_length("head")).cast("bigint").alias("start"), F.char_length("body").cast("bigint").alias("length"))).alias("loss"),
    )
    w = t.groupBy("conv_id", "win").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("n").alias("n"), F.first("system").alias("system"))
    reopened = (F.col("win") > 0) & F.col("system").isNotNull()
    lead_n = F.when(reopened, F.col("system.n")).otherwise(F.lit(0))
    n_repeated = F.size(F.filter("turns", lambda x: x["repeated"])) + reopened.cast("int")
    return w.select(
        "conv_id",
        "win",
        F.concat(F.when(reopened, F.col("system.piece")).otherwise(F.lit("")), F.array_join(F.col("turns.piece"), "")).alias("formatted"),
        F.filter(F.col("turns.loss"), lambda x: x.isNotNull()).alias("loss"),
        (F.size("turns") + reopened.cast("int")).alias("n_turns"),
        n_repeated.alias("n_repeated"),
        (F.col("n") + lead_n).alias("n_tokens"),
        (F.col("n") + lead_n > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss`` alone: conv_id, win, ``turns`` (role, text), ``loss_texts``, ``n_chars``."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    fresh = F.slice(pieces, F.col("n_repeated") + 2, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))

    def parsed(piece: Column) -> Column:
        role = F.substring_index(piece, ROLE_END, 1)
        text = piece.substr(F.char_length(role) + 2, F.char_length(piece) - F.char_length(role) - (1 + len(TURN_END)))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return windows.select(
        "conv_id",
        "win",
        F.transform(fresh, parsed).alias("turns"),
        F.transform("loss", lambda x: unescape(F.col("formatted").substr((x["start"] + 1).cast("int"), x["length"].cast("int")))).alias("loss_texts"),
        F.char_length("formatted").cast("bigint").alias("n_chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation: what its windows say when read back."""
    parts = read_back(windows).select(
        "conv_id",
        F.size("turns").alias("n"),
        "n_chars",
        F.struct("win", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"), F.array_join("loss_texts", "").alias("taught")).alias("part"),
    )
    c = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    said, taught = F.array_join("parts.said", ""), F.array_join("parts.taught", "")
    return c.select(
        "conv_id",
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(taught).cast("bigint").alias("loss_chars"),
        F.sha2(taught.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
