"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.plans.ordered import running_sum

#: Speakers that set the scene and take no turn as assistant.
SCENE = ("system",)
#: Name of a speaker that is not given.
UNNAMED = "unknown"
#: Turn numbers that one part of a dialogue spans; turns that one part of what has no conv_id holds.
TURNS_PER_PART = 512

#: Fixed marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _header(role: Column, perspective: Column) -> Column:
    return (
        F.when(role.isin(*SCENE), F.concat(F.lit(OPEN), role, F.lit("\n")))
        .when(role == perspective, F.lit(OPEN + "assistant\n"))
        .otherwise(F.concat(F.lit(OPEN + "user name="), role, F.lit("\n")))
    )


def _parts_without_id(turns: DataFrame, turns_per_part: int) -> DataFrame:
    """Parts of the rows without a conversation, by their places in the order of turn, role and text.

    Equal rows are of different dialogues, so all are kept. They are counted before the shuffle, and a row of which
    there are many is dealt to the parts it reaches into.
    """
    cells = ["turn", "role", "text"]
    counted = turns.filter("conv is null").groupBy(*cells).agg(F.count("*").alias("n"))
    placed = running_sum(counted, cells, "n", "before")
    first, last = F.floor(F.col("before") / turns_per_part), F.floor((F.col("before") + F.col("n") - 1) / turns_per_part)
    placed = placed.select("*", F.explode(F.sequence(first, last)).alias("part"))
    begin = F.greatest(F.col("before"), F.col("part") * turns_per_part)
    copies = F.least(F.col("before") + F.col("n"), (F.col("part") + 1) * turns_per_part) - begin
    turn = F.array_repeat(F.struct(*cells), copies.cast("int"))
    grouped = placed.groupBy("part").agg(F.sort_array(F.flatten(F.collect_list(turn))).alias("turns"))
    return grouped.select(F.lit(None).cast(turns.schema["conv"].dataType).alias("conv"), "part", "turns")


def rotate(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """Render every dialogue once for each of its participants.

    Returns conv_id, perspective, part, ``text``, ``targets`` (start and end, in characters of the text, of what is
    trained on: the perspective's own words and the mark that ends them), n_turns, n_targets and n_target_chars.
    Turns are rendered in the order of their number; turns of equal number by role, then text. A dialogue is cut
    into parts of ``turns_per_part`` consecutive turn numbers, given by ``turn`` alone, so a dialogue that holds a
    third of all rows is spread over tasks if its turns bear numbers of their own; distinct turns that share a number,
    or have none, stay in one part however many they are. The parts, in order, are the whole dialogue, and every
    participant gets every part.

    Scene speakers (system) keep their role and are no participants; a dialogue without participants gives no
    rows. A null or empty role is the speaker "unknown"; a null text is empty; turns without a number come first,
    in part null. Exact repeats of a turn (same number, role and text) are rendered once. Rows without a conv_id are
    a dialogue of their own, of any number of real ones: their repeats are all rendered, and their parts hold
    ``turns_per_part`` turns each, by place in the order, turns without a number first. Columns beside the four named ones are not looked at. An empty table gives no rows.
    """
    turns = df.select(
        F.col(f"`{conv_id}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.nullif(F.col(f"`{role}`"), F.lit("")), F.lit(UNNAMED)).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    part = F.floor(F.col("turn") / turns_per_part)
    distinct = turns.filter("conv is not null").distinct().withColumn("part", part)
    parts = distinct.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = parts.unionByName(_parts_without_id(turns, turns_per_part))
    speakers = turns.filter(~F.col("role").isin(*SCENE)).select(F.col("conv").alias("of"), F.col("role").alias("perspective"))
    rows = parts.join(speakers.distinct(), F.col("conv").eqNullSafe(F.col("of")))
    me = F.col("perspective")

    def cell(t: Column) -> Column:
        return F.struct(
            _header(t["role"], me).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            (t["role"] == me).alias("own"),
        )

    rows = rows.withColumn("cells", F.transform("turns", cell))
    rendered = F.array_join(F.transform("cells", lambda c: F.concat(c["head"], c["body"])), "")

    # running position, and the spans of own turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(seen: Column, c: Column) -> Column:
        body = seen["at"] + F.char_length(c["head"])
        after = body + F.char_length(c["body"])
        span = F.struct(body.alias("start"), (after - 1).alias("end"))  # without the line feed behind the end mark
        return F.struct(after.alias("at"), F.when(c["own"], F.array_append(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    spans = F.aggregate("cells", start, step)["spans"]
    rows = rows.select(
        F.col("conv").alias("conv_id"), "perspective", "part", rendered.alias("text"), spans.alias("targets"),
        F.size("turns").cast("long").alias("n_turns"),
    )
    chars = F.aggregate("targets", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.withColumn("n_targets", F.size("targets").cast("long")).withColumn("n_target_chars", chars)
