"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: the formatted conversation up to and with
that turn, of which only the reply itself is under the loss mask. Turns after the last reply
(or a conversation without any) come as one more example with an empty mask, so the examples
always hold the whole conversation.

Template: ``<s>[INST]role[/INST]text</s>`` for each turn. Control strings inside roles and texts
are broken up by a backslash after their first bracket or slash, and backslashes are doubled;
`unescaped` undoes exactly that.

Cases: null role or text counts as empty; null conversation ids form one conversation; turns are
ordered by turn (null first), role and text, so ties and repeated rows all stay in a defined
order; an empty table gives no example; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
REPLY_ROLE = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])(/?)(?=s>|INST\])", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations_formatted(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, full (formatted text), ends (code points up to
    the end of each turn), masks (loss span of each turn, null where it isn't a reply)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), (t["role"] == REPLY_ROLE).alias("reply"))

    cut = packed.select("conv_id", F.transform("turns", parts).alias("parts"))
    sized = cut.withColumn("lengths", F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)))
    start = F.array(F.lit(0)).cast("array<int>")
    ends = F.slice(F.aggregate("lengths", start, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), F.lit(2), F.size("lengths"))
    full = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    placed = sized.select("conv_id", "parts", full.alias("full"), ends.alias("ends"))

    def mask(p: Column, end: Column) -> Column:
        stop = end - len(CLOSE)
        return F.when(p["reply"], F.struct((stop - F.length(p["body"])).alias("start"), stop.alias("end")))

    return placed.select("conv_id", "full", "ends", F.zip_with("parts", "ends", mask).alias("masks"))


def prefix_examples(turns: DataFrame) -> DataFrame:
    """One row for each example: conv_id, example (0, 1, ...), n_turns, trainable, text,
    loss_start and loss_end (code points, half open; equal where nothing is trainable).

    Turns meet in one shuffle on conv_id; the examples come out partitioned by it."""
    packed = conversations_formatted(turns)
    picked = F.filter(
        F.transform("masks", lambda m, i: F.struct((i + 1).alias("n_turns"), m.alias("mask"))),
        lambda x: x["mask"].isNotNull() | (x["n_turns"] == F.size("masks")),
    )
    wide = packed.select("conv_id", "full", "ends", F.posexplode(picked).alias("example", "x"))
    stop = F.element_at("ends", F.col("x.n_turns"))
    return wide.select(
        "conv_id", "example", F.col("x.n_turns").alias("n_turns"), F.col("x.mask").isNotNull().alias("trainable"),
        F.substring("full", F.lit(1), stop).alias("text"),
        F.coalesce("x.mask.start", F.lit(0)).alias("loss_start"), F.coalesce("x.mask.end", F.lit(0)).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), control strings undone."""
    inner = F.substring(text, F.lit(1), F.length(text) - len(CLOSE))

    def turn(part: Column) -> Column:
        cut = F.split(part, r"\[/INST\]")
        return F.struct(unescaped(F.substring(cut[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescaped(cut[1]).alias("text"))

    return F.transform(F.split(inner, CLOSE), turn)


def loss_text(examples: DataFrame) -> Column:
    """What the mask of an example covers, control strings undone."""
    return unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Reads the examples back: for each conversation its turns (from its longest example) and
    all text under the loss masks, as digests."""
    grouped = examples.select("*", loss_text(examples).alias("loss")).groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    told = grouped.select(
        "conv_id", "formatted_chars", read_turns(F.col("longest")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
