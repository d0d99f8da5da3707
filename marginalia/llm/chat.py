"""Multi-party perspective rotation: a dialogue is rendered once for every participant, with that speaker as the
assistant, the others as named users, and loss spans over the assistant's own text only.

A dialogue is one row for each participant, whole, however many turns it has, as it is one training example; so its
turns meet in one task, where they are sorted and numbered in streams that can spill. ``max_turns`` (off by default)
cuts longer dialogues into parts of so many turns, by their place in the dialogue; every part begins with the context
turns before it. Roles in CONTEXT (system) are rendered for everybody and are no participants. Spans are offsets of
characters in the rendered text; where a turn begins is summed up once for all participants.

What stands in texts and names cannot pass for a mark: ``<|`` in a text is written ``<||``, and ``|`` in a name ``||``.

Edge cases: null text is empty; a null role is a speaker named ``unknown``; a turn without a conversation is a dialogue
of its own; null turns come first; equal turns follow in the order of role and text; repeated rows are repeated turns;
a dialogue of context alone has no participant and no row; a very long text is rendered whole; further columns,
whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import col, table

CONTEXT = ("system",)
CLOSE = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"


def _tag(role: Column) -> Column:
    """What stands before a turn of a role that is not the speaker's."""
    name = F.when(role.isin(*CONTEXT), role).otherwise(F.concat(F.lit("user name="), F.replace(role, F.lit("|"), F.lit("||"))))
    return F.concat(F.lit("<|"), name, F.lit("|>\n"))


def _parts(rows: DataFrame, max_turns: int) -> DataFrame:
    """rows with a part by their place in the dialogue, and the context turns again in all parts after their own."""
    rows = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("conv").orderBy(*ORDER)) - 1) / max_turns))
    last = rows.groupBy("conv").agg(F.max("part").alias("last")).where("last > 0")
    again = rows.where(F.col("role").isin(*CONTEXT)).join(last, "conv").where("part < last")
    again = again.withColumn("part", F.explode(F.sequence(F.col("part") + 1, "last"))).withColumn("again", F.lit(True))
    return rows.unionByName(again.drop("last"))


ORDER = ("turn", "role", "text")


def rotate(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_turns: int | None = None) -> DataFrame:
    """conv_id, participant, part, n_turns, text, mask (array of start and end, the end mark included)."""
    shown = F.replace(F.coalesce(col(text), F.lit("")), F.lit("<|"), F.lit("<||"))
    rows = conversations.select(
        col(conv_id).alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit("unknown")).alias("role"), shown.alias("text"), F.lit(False).alias("again"), F.lit(0).cast("long").alias("part")
    )
    size = F.length(_tag(F.col("role"))) + F.length("text") + len(CLOSE)
    rows = rows.withColumn("size", size.cast("long"))
    alone = rows.where("conv IS NULL").select("conv", "part", F.array(F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("at"), "role", "text")).alias("said"))
    rows = rows.where("conv IS NOT NULL")
    if max_turns is not None:
        rows = _parts(rows, max_turns)
    # one shuffle: numbers and sums within a dialogue, then its turns as an array; equal turns are interchangeable
    order = Window.partitionBy("conv", "part").orderBy(F.desc("again"), *ORDER)
    at = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = rows.select("conv", "part", "role", "text", F.row_number().over(order).alias("n"), at.alias("at"))
    said = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("n", "at", "role", "text"))).alias("said")).unionByName(alone)
    people = F.array_except(F.array_distinct(F.col("said.role")), F.array(*[F.lit(x) for x in CONTEXT]))
    if max_turns is not None:  # who speaks in any part
        speakers = said.select("conv", F.explode(people).alias("participant")).where("conv IS NOT NULL").distinct()
        out = said.where("conv IS NOT NULL").join(speakers, "conv").unionByName(said.where("conv IS NULL").select("conv", "part", "said", F.explode(people).alias("participant")))
    else:
        out = said.select("conv", "part", "said", F.explode(people).alias("participant"))
    speaker = F.col("participant")
    # the speaker's own mark is longer or shorter than the one that others see, by the same for each turn
    moved = F.lit(len(ASSISTANT)) - F.length(_tag(speaker))
    own = F.filter("said", lambda x: x["role"] == speaker)
    start = lambda x, k: x["at"] + k * moved + len(ASSISTANT)
    mask = F.transform(own, lambda x, k: F.struct(start(x, k).alias("start"), (start(x, k) + F.length(x["text"]) + len(CLOSE) - 1).alias("end")))
    rendered = F.array_join(F.transform("said", lambda x: F.concat(F.when(x["role"] == speaker, F.lit(ASSISTANT)).otherwise(_tag(x["role"])), x["text"], F.lit(CLOSE))), "")
    return out.select(F.col("conv").alias("conv_id"), "participant", "part", F.size("said").alias("n_turns"), rendered.alias("text"), mask.alias("mask"))


def op6_chat(spark, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), " ")
    return out.select("conv_id", "participant", "part", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("mask"))


OP6_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<||') AS text,
  CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE conv_id::VARCHAR END AS dialogue FROM conversations),
p AS (SELECT DISTINCT dialogue, role AS participant FROM r WHERE role <> 'system'),
o AS (SELECT r.*, participant, CASE WHEN role = 'system' THEN '<|system' WHEN role = participant THEN '<|assistant' ELSE '<|user name=' || replace(role, '|', '||') END || '|>' || chr(10) AS before
  FROM r JOIN p USING (dialogue)),
e AS (SELECT *, before || text || '{CLOSE.strip()}' || chr(10) AS piece FROM o),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY dialogue, participant ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS til FROM e)
SELECT conv_id, participant, 0::BIGINT AS part, count(*) AS n_turns, string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg((til - length(piece) + length(before))::VARCHAR || ':' || (til - 1)::VARCHAR, ' ' ORDER BY turn NULLS FIRST, role, text) FILTER (role = participant), '') AS mask
FROM s GROUP BY conv_id, dialogue, participant
"""
