"""Chat formatting in budgeted windows of whole turns; built-in functions only.

Turns of a conversation are numbered, and prefix sums of their tokens cut the conversation into spans: a span's new
turns begin in one cell of half the budget. What a window repeats counts: a turn that, behind a full cell, would leave no
room for the history budget and the system turn is a span by itself. So a window of several new turns keeps the budget;
one of a single new turn may be as long as that turn needs, for turns are never cut. Every later window repeats the
system turn and the turns just before the span whose tokens, counted back from it, fit the history budget; what is
repeated is masked, so that the loss sees each assistant turn once.

Template: ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash goes before the second character of
every control string and before every backslash; to read back, drop each backslash and keep what follows it.

Defined results: null role or text is empty; a null conv_id is a conversation of its own; turns are ordered by turn
(null first), then role, then text, and repeated rows are turns of their own; an empty table gives an empty table; extra
columns are ignored. Prefix sums run by chunks of turn numbers and then over chunk totals, so a long conversation is
spread out, and a window is the largest thing that is gathered; a very long turn is one row. Numbered turns are written
once, and which turns a window repeats is found on their numbers alone, without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words

#: The template's marks, and control strings of common templates that texts must not forge.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens that the marks of a turn count for.
OVERHEAD = 4
CHUNK = 64


def escape(x: Column) -> Column:
    x = F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        x = F.replace(x, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _numbered(df: DataFrame, budget: int, history: int) -> DataFrame:
    """k, conv_id, pos, role, text, tokens, before (tokens of all earlier turns), cell and big (which name the span).

    Texts are shuffled once, by chunks of a conversation; what crosses chunks are their totals.
    """
    size, half = (F.size(words(F.col("text"))) + OVERHEAD).cast("long"), budget // 2
    t = df.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select("*", size.alias("tokens"), F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))).alias("chunk"))
    order = Window.partitionBy("k", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inner = t.select("*", F.row_number().over(order).alias("i"), F.sum("tokens").over(upto).alias("upto"))
    lead = F.max(F.when((F.col("i") == 1) & (F.col("role") == "system"), F.col("tokens"))).alias("lead")
    totals = inner.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"), lead)
    first = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    heads = totals.select("k", "chunk", *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(c) for c in ("n", "s")], F.coalesce(F.first("lead").over(first), F.lit(0)).alias("lead"))
    at = inner.join(heads, ["k", "chunk"]).withColumn("is_big", (F.col("tokens") > F.greatest(F.lit(budget - history - half) - F.col("lead"), F.lit(0))).cast("long"))
    at = at.withColumn("bigs", F.sum("is_big").over(upto))
    more = at.groupBy("k", "chunk").agg(F.sum("is_big").alias("g")).select("k", "chunk", F.coalesce(F.sum("g").over(prior), F.lit(0)).alias("g"))
    at = at.join(more, ["k", "chunk"]).withColumn("before", F.col("s") + F.col("upto") - F.col("tokens"))
    return at.select(
        "k", "conv_id", (F.col("n") + F.col("i") - 1).cast("long").alias("pos"), "role", "text", "tokens", "before",
        F.floor(F.col("before") / half).alias("cell"), (2 * (F.col("g") + F.col("bigs")) - F.col("is_big")).alias("big"),
    )


def format_windows(df: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """(conv_id, turn, role, text) to one row per window: conv_id, start, n_repeated, n_new, tokens, text, loss_spans.

    loss_spans: array of (start, length), in code points of the formatted text, 0-based.
    """
    t = materialise(_numbered(df, budget, history))
    span = ("k", "cell", "big")
    starts = materialise(t.groupBy(*span).agg(F.min(F.struct("pos", "before")).alias("x")).select(*span, "x.*").where("pos > 0"))
    reach = max(1, history // OVERHEAD)
    first = F.greatest(F.lit(0).cast("long"), F.col("pos") - reach)
    back = starts.select(*span, F.col("before").alias("upto"), F.explode(F.sequence(first, F.col("pos") - 1)).alias("pos"))
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    near = t.where(~system).select("k", "pos", "before").join(back, ["k", "pos"]).where(F.col("upto") - F.col("before") <= history).select(*span, "pos")
    columns = (*span, "conv_id", "pos", "new", "role", "text", "tokens")
    old = t.drop("cell", "big").join(near, ["k", "pos"]).withColumn("new", F.lit(False)).select(*columns)
    lead = starts.select(*span).join(t.where(system).drop("cell", "big"), "k").withColumn("new", F.lit(False)).select(*columns)
    fresh = t.withColumn("new", F.lit(True)).select(*columns)
    every = fresh.unionByName(old).unionByName(lead)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    seg = F.struct("pos", "new", ((F.col("role") == "assistant") & F.col("new")).alias("loss"), "tokens", head.alias("head"), escape(F.col("text")).alias("body"))
    win = every.groupBy(*span).agg(F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_list(seg)).alias("s"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        from_, n = a["at"] + F.length(s["head"]), F.length(s["body"]).cast("long")
        spans = F.when(s["loss"], F.array_append(a["spans"], F.struct(from_.alias("start"), n.alias("length")))).otherwise(a["spans"])
        return F.struct((from_ + n + len(END)).alias("at"), spans.alias("spans"))

    return win.select(
        "conv_id",
        F.array_min(F.transform(F.filter("s", lambda s: s["new"]), lambda s: s["pos"])).alias("start"),
        F.size(F.filter("s", lambda s: ~s["new"])).alias("n_repeated"),
        F.size(F.filter("s", lambda s: s["new"])).alias("n_new"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]).alias("tokens"),
        F.array_join(F.transform("s", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "").alias("text"),
        F.aggregate("s", begin, step)["spans"].alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold, per conversation: turns and loss text parsed from the text alone."""
    parts = F.slice(F.split("text", r"<\|end\|>"), F.col("n_repeated") + 1, F.col("n_new"))

    def turn(p: Column) -> Column:
        cut = F.split(p, r"<\|text\|>")
        return F.concat(unescape(F.substring(cut[0], len(TURN) + 1, 1 << 30)), F.lit("\n"), unescape(cut[1]), F.lit("\n"))

    lost = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    each = windows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"), "conv_id", "start", F.size(parts).cast("long").alias("n"),
        F.array_join(F.transform(parts, turn), "").alias("turns"), F.array_join(lost, "").alias("loss"), F.length("text").cast("long").alias("chars"),
    )
    got = each.groupBy("k").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("start", "turns", "loss"))).alias("w"),
    )
    whole = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return got.select(
        "conv_id", "n_turns", F.sha2(whole("turns").cast("binary"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
