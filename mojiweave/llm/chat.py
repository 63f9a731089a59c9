"""Chat formatting into budgeted, turn-aligned windows, in DataFrame functions only.

A conversation's turns are put in order (turn, then role and text by a digest; null turns first) and
their tokens summed up from the start. These prefix sums deal the turns into blocks of BLOCK_WINDOWS
budgets, and in each block, which is bounded by its tokens, spans are filled greedily up to what the
budget leaves for new turns: only a block's last window may stay partly empty. Each window has, in
order: the system turn, the turns before the span that lie within the history budget, and the span.
Repeated turns are masked: the loss covers the texts of the span's assistant turns only, so every
assistant text is a target once. The system turn stays in every window, whatever its size: history
shrinks first, so that a quarter of the budget is left for new turns where that is possible. A
window that is over the budget even so (a long turn, which is never cut, or a long system turn) is
marked over_budget.

Tokens are those of `tokens`, a Column function of the text; without one, of token_bound(), which is
meant never to be too low. Rows are ordered and summed without their texts, in range partitions cut
inside long conversations too, so neither a conversation nor a turn number that many rows share is
one task. A window's turns are bounded by its budget.

Template: `<|im_start|>role`, a line feed, the text, `<|im_end|>`, a line feed. In texts and roles
each `<`, any backslashes and `|` get one more backslash after `<`; a role's line feeds and
backslashes are escaped too. Reading back takes these away, so every text round-trips.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; repeated
rows are turns of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mojiweave.llm import common

BUDGET, HISTORY, BLOCK_WINDOWS = 2048, 256, 16
#: Tokens of the markup and the role of a turn.
MARKUP = 8
START, END = "<|im_start|>", "<|im_end|>\n"


def token_bound(text: Column) -> Column:
    """A native upper estimate of a text's tokens: one for each two letters A-Z of a run, for each digit and other visible ASCII sign, and for each byte of any other character.

    No byte-level vocabulary needs more for digits, signs and other scripts; for runs of letters the
    half is an estimate, tested against real tokenizers. Exact counts can be given to format_windows().
    """
    return F.regexp_count(text, F.lit(r"[A-Za-z]{1,2}|[\x21-\x40\x5B-\x60\x7B-\x7E]")) + F.octet_length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _placed(rows: DataFrame) -> DataFrame:
    """conv_id, id, size, is_system and begin (tokens before the turn in its conversation), with sys_begin, sys_id and sys_size of its first system turn; rows: those without texts.

    Sums are taken in two levels: inside the parts of a range partitioning, and over parts.
    """
    order = ["conv_id", "turn", "tie", "id"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = common.materialize(parts.select("conv_id", "id", "size", "is_system", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "ordered_turns")
    local = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.withColumn("_begin", F.coalesce(F.sum("size").over(local), F.lit(0)))
    sums = inner.groupBy("conv_id", "part").agg(F.sum("size").alias("s"), F.min(F.when(F.col("is_system"), F.struct("_begin", "id", "size"))).alias("x"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("s").over(before), F.lit(0)))
    first = F.min(F.when(F.col("x").isNotNull(), F.struct((F.col("x._begin") + F.col("_base")).alias("begin"), "x.id", "x.size"))).over(Window.partitionBy("conv_id"))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "_base", first.alias("system"))
    joined = inner.join(sums, inner["conv_id"].eqNullSafe(sums["_c"]) & (inner["part"] == sums["_p"]))
    return joined.select("conv_id", "id", "size", (F.col("_begin") + F.col("_base")).alias("begin"), "system")


def _planned(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, id, window, place, begin, size, repeated): the turns of every window; window is the tokens before its first new turn."""
    width = BLOCK_WINDOWS * budget
    own = placed.withColumn("block", F.floor(F.col("begin") / width)).withColumn("ghost", F.lit(False))
    # turns near a block's end may be history of the next one
    ghosts = own.filter(F.pmod(F.col("begin"), F.lit(width)) >= width - history).withColumn("block", F.col("block") + 1).withColumn("ghost", F.lit(True))
    blocks = own.unionByName(ghosts).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("begin", "id", "size", "ghost"))).alias("t"), F.first("system").alias("system"))
    used = F.coalesce(F.col("system.size"), F.lit(0))
    back = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget - budget // 4) - used))
    blocks = blocks.withColumn("back", back).withColumn("room", F.greatest(F.lit(0), F.lit(budget) - used - back)).withColumn("new", F.filter("t", lambda x: ~x["ghost"]))

    def fill(a: Column, x: Column) -> Column:
        full = (F.size(a["starts"]) == 0) | (a["used"] + x["size"] > F.col("room"))
        return F.when(full, F.struct(x["size"].alias("used"), F.concat(a["starts"], F.array(x["begin"])).alias("starts"))).otherwise(F.struct((a["used"] + x["size"]).alias("used"), a["starts"].alias("starts")))

    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("starts"))
    blocks = blocks.withColumn("starts", F.aggregate("new", none, fill)["starts"])

    def turn(window: Column, place: int, x: Column, repeated: bool) -> Column:
        return F.struct(x["id"].alias("id"), window.alias("window"), F.lit(place).alias("place"), x["begin"].alias("begin"), x["size"].alias("size"), F.lit(repeated).alias("repeated"))

    fresh = F.transform("new", lambda x: turn(F.array_max(F.filter("starts", lambda s: s <= x["begin"])), 2, x, False))
    system = F.col("system")
    kept = F.transform(F.filter("starts", lambda s: system.isNotNull() & (system["begin"] < s)), lambda s: turn(s, 0, system, True))
    past = F.flatten(F.transform("starts", lambda s: F.transform(F.filter("t", lambda x: (x["begin"] < s) & (x["begin"] >= s - F.col("back")) & ~F.coalesce(x["id"] == system["id"], F.lit(False))), lambda x: turn(s, 1, x, True))))
    return blocks.select("conv_id", F.inline(F.concat(fresh, kept, past)))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = token_bound) -> DataFrame:
    """A row per window: conv_id, window, formatted, loss array<struct<start, length>> (characters of formatted), n_turns, n_repeated (leading turns seen before), n_tokens, over_budget.

    tokens is called with the text's Column; it may return another column of turns that holds exact counts.
    """
    if not 0 <= history < budget // 2:
        raise ValueError("history must be under half of the budget")
    counted = tokens(F.coalesce("text", F.lit(""))).cast("long") + MARKUP
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(counted, F.lit(MARKUP)).alias("size"))
    rows = common.materialize(rows.withColumn("id", F.monotonically_increasing_id()), "turns")
    narrow = rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("tie"), "id", "size", (F.col("role") == "system").alias("is_system"))
    plan = _planned(_placed(narrow), budget, history)
    out = plan.join(rows.select("id", "role", "text"), "id")
    parts = out.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("place", "begin", "repeated", "role", "text"))).alias("t"), F.count(F.lit(1)).alias("n_turns"), F.count_if("repeated").alias("n_repeated"), F.sum("size").alias("n_tokens")
    )
    shown = F.transform("t", lambda x: F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), ((x["role"] == "assistant") & ~x["repeated"]).alias("target")))
    parts = parts.withColumn("t", shown)

    def masked(a: Column, x: Column) -> Column:
        at, size = a["at"] + F.length(x["head"]), F.length(x["body"]).cast("long")
        span = F.array(F.struct(at.alias("start"), size.alias("length")))
        return F.struct((at + size + len(END)).alias("at"), F.when(x["target"] & (size > 0), F.concat(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    return parts.select("conv_id", "window", text.alias("formatted"), F.aggregate("t", none, masked)["loss"].alias("loss"), "n_turns", "n_repeated", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def turns_of(formatted: Column, n_turns: Column, n_repeated: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text that its window does not repeat, read back."""
    # a text holds no marker, so each piece between start markers is one turn
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), n_repeated.cast("int") + 2, F.greatest((n_turns - n_repeated).cast("int"), F.lit(0)))

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        return F.struct(unescape_role(F.substr(p, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(p, cut + 1, F.length(p) - cut - len(END))).alias("text"))

    return F.transform(pieces, turn)


def targets_of(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask of a formatted text, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))


def read_turns(windows: DataFrame) -> DataFrame:
    """Windows with turns array<struct<role, text>>, read back: those that the window does not repeat."""
    return windows.withColumn("turns", turns_of(F.col("formatted"), F.col("n_turns"), F.col("n_repeated")))


def loss_text(windows: DataFrame) -> DataFrame:
    """Windows with targets, the texts under the loss mask."""
    return windows.withColumn("targets", targets_of(F.col("formatted"), F.col("loss")))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), marks.alias("text"))
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    windows = format_windows(turns)
    whole = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "formatted", "loss", "n_turns", "n_repeated"))).alias("w"), F.sum("n_turns").alias("a"), F.sum("n_repeated").alias("b"), F.sum(F.length("formatted")).alias("chars"), F.count(F.lit(1)).alias("n_windows"))
    said = F.transform("w", lambda w: F.array_join(F.transform(turns_of(w["formatted"], w["n_turns"], w["n_repeated"]), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    target = F.transform("w", lambda w: F.array_join(targets_of(w["formatted"], w["loss"]), ""))
    read = whole.select("conv_id", (F.col("a") - F.col("b")).alias("n_turns"), F.array_join(said, "").alias("said"), F.array_join(target, "").alias("target"), F.col("chars").cast("long").alias("formatted_chars"), "n_windows")
    return read.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("target").cast("long").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
