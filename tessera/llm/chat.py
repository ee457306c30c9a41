"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so a text can't open or close a turn and unescaping gives it back.

A turn costs OVERHEAD tokens and one for every BYTES_PER_TOKEN bytes of its escaped text. Windows are turn-aligned spans chosen on the
prefix sums of these costs: a window takes turns while their sum stays within what its budget leaves beside the
system turn and the repeated history, and one turn at least (a turn over the budget stands alone, whole). Every
window repeats the leading system turn and, before its own turns, the last turns that fit into the history budget. Loss falls on
assistant texts of a window's own turns; those it repeats are masked, so each assistant text is a target once.

Defined cases: null role and null text are empty; turns are ordered by their number, ties by role and text; rows without
conv_id form one conversation with a null id; a conversation of repeated rows keeps every row; an empty table has no windows; further
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY, OVERHEAD, BYTES_PER_TOKEN = 512, 128, 6, 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order, their costs and the costs' prefix sums."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("body", escape(F.col("text"))).withColumn("name", escape(F.col("role")))
    cost = (F.ceil(F.octet_length("body") / BYTES_PER_TOKEN) + OVERHEAD).cast("long")
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cost", cost).withColumn("upto", F.sum("cost").over(in_order)).withColumn("nth", F.row_number().over(in_order))
    turn = F.struct("nth", "role", "text", F.concat(F.lit(START), "name", F.lit("\n"), "body", F.lit(END)).alias("written"), (F.length("name") + len(START) + 1).cast("long").alias("skip"), F.length("body").cast("long").alias("size"), "cost", "upto")
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.withColumn("sums", F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda t: t["upto"])))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows (conv_id, window, formatted, n_repeated, n_turns, loss): loss is an array of (start, length) in characters of
    ``formatted``, start from 0; the first n_repeated turns are repeats."""
    base = _turns(conversations)
    system = F.when(F.col("turns")[0]["role"] == "system", 1).otherwise(0)
    base = base.withColumn("sys", system).withColumn("sys_cost", F.when(F.col("sys") == 1, F.col("turns")[0]["cost"]).otherwise(0))
    first_room = F.lit(budget)
    later_room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("sys_cost"))
    size = F.size("turns")
    # cuts: numbers of turns before each window; a turn that passes the room of the window begun last begins the next
    cuts = F.aggregate(
        F.sequence(F.lit(1), size),
        F.array(F.lit(0)),
        lambda acc, i: F.when(
            (F.element_at("sums", i + 1) - F.element_at("sums", F.element_at(acc, -1) + 1) > F.when(F.size(acc) == 1, first_room).otherwise(later_room)) & (i - 1 > F.element_at(acc, -1)),
            F.concat(acc, F.array(i - 1)),
        ).otherwise(acc),
    )
    base = base.withColumn("cuts", cuts)
    each = base.select("conv_id", "turns", "sums", "sys", "cuts", F.posexplode("cuts").alias("window", "lo"))
    each = each.withColumn("hi", F.coalesce(F.get("cuts", F.col("window") + 1), F.size("turns")))
    # history: the last turns before lo, beyond the system turn, that fit into the history budget
    past = F.size(F.filter(F.slice("sums", F.lit(1), F.col("lo")), lambda s: F.get("sums", F.col("lo")) - s <= history))
    each = each.withColumn("back", F.when(F.col("window") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(past, F.col("lo") - F.col("sys")))))
    each = each.withColumn("again", F.when(F.col("window") == 0, F.lit(0)).otherwise(F.col("sys")))
    shown = F.concat(F.slice("turns", F.lit(1), F.col("again")), F.slice("turns", F.col("lo") - F.col("back") + 1, F.col("back") + F.col("hi") - F.col("lo")))
    each = each.select("conv_id", "window", (F.col("again") + F.col("back")).alias("n_repeated"), shown.alias("shown"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.array(F.struct((acc["at"] + t["skip"]).alias("start"), t["size"].alias("length")))
        target = (t["role"] == "assistant") & (acc["k"] >= F.col("n_repeated"))
        return F.struct((acc["at"] + F.length(t["written"])).cast("long").alias("at"), (acc["k"] + 1).alias("k"), F.when(target, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate("shown", start, step, lambda acc: acc["spans"])
    return each.select("conv_id", "window", F.array_join(F.transform("shown", lambda t: t["written"]), "").alias("formatted"), "n_repeated", F.size("shown").alias("n_turns"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows alone: per conversation its turns and the text under the loss mask, unescaped."""
    body = F.expr(r"regexp_extract_all(formatted, '(?s)<\\|im_start\\|>.*?<\\|im_end\\|>\n', 0)")
    own = F.filter(body, lambda t, k: k >= F.col("n_repeated"))
    plain = F.transform(own, lambda t: F.substring(t, len(START) + 1, 2**31 - 1 - len(START)))
    plain = F.transform(plain, lambda t: unescape(F.substring(t, F.lit(1), F.length(t) - len(END))))
    target = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    parts = formatted.select("conv_id", F.struct("window", F.size(own).alias("n"), F.array_join(F.transform(plain, lambda t: F.concat(t, F.lit("\n"))), "").alias("text"), target.alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select("conv_id", total("n").alias("n_turns"), joined("text").alias("turns_text"), joined("loss").alias("loss_text"), total("chars").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"))
