"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
named users; system turns stay system turns, and the system takes no perspective. The loss mask of a perspective covers
the assistant's texts with their end marks.

A rendered dialogue is returned segment by segment with its place in the whole: a row for each turn and perspective,
with the start of its text in the dialogue and the span under the mask. So no task ever holds a whole conversation; a
conversation of any length is laid out by running sums in three levels (turns of one number, blocks of turns, blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SYSTEM = "system"
#: Fixed values of the format.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def header(role: Column, perspective: Column) -> Column:
    who = F.when(role == perspective, F.lit("assistant")).when(role == SYSTEM, role).otherwise(F.concat(F.lit("user name="), F.coalesce(role, F.lit("unknown"))))
    return F.concat(F.lit(OPEN), who, F.lit(MIDDLE))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, segment, turn, role, rendered, start, length, loss_start and loss_length of each segment.

    Segments are numbered from 0 in the order of turn (null first), then role (null first), then text; lengths are in
    characters; loss_start is the place in the dialogue of what the mask covers, -1 where it covers nothing.
    Participants are the distinct roles but null and system; a conversation without one gives no rows. Null text is
    empty, a null role speaks as the user named unknown, null conv_id is a conversation of its own. Repeated rows are
    segments each, counted before anything is shuffled by conversation. An empty table gives no rows; extra columns are
    ignored.

    What one role says in one turn is a seat. Places are worked out from the seats' numbers of segments and characters, which
    are a few numbers whatever the texts; texts are shuffled twice, and multiplied by perspectives only in the result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    # Structs compare null with null as equal, so they are keys in joins too.
    said = said.select(F.struct("conv_id", "turn", "role").alias("seat"), "text", "times", (F.col("times") * F.length("text")).alias("chars"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda name, w: F.coalesce(F.sum(name).over(before(w)), F.lit(0)).cast("long")
    w0 = Window.partitionBy("seat").orderBy("text")
    said = said.withColumns({"x_times": running("times", w0), "x_chars": running("chars", w0)})
    seats = rows.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("times"), F.sum(F.length("text")).alias("chars"))
    seats = seats.select(F.struct("conv_id").alias("conv"), F.col("turn"), F.col("role"), "times", "chars")
    people = rows.filter(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.struct("conv_id").alias("p_conv"), F.col("role").alias("perspective")).distinct()
    each = seats.join(people, F.col("conv") == F.col("p_conv")).drop("p_conv")
    frame = F.length(header(F.col("role"), F.col("perspective"))) + len(CLOSE)
    each = each.withColumns({"chars": F.col("chars") + F.col("times") * frame, "block": F.floor(F.col("turn") / BLOCK)})
    # Roles within a turn; turns within a block; blocks within a conversation.
    who = ["conv", "perspective"]
    turns = each.groupBy(*who, "block", "turn").agg(F.sum("times").alias("t_times"), F.sum("chars").alias("t_chars"))
    blocks = turns.groupBy(*who, "block").agg(F.sum("t_times").alias("b_times"), F.sum("t_chars").alias("b_chars"))
    w3 = Window.partitionBy(*who).orderBy(F.col("block").asc_nulls_first())
    blocks = blocks.select(F.struct(*who, "block").alias("b_key"), running("b_times", w3).alias("b_segment"), running("b_chars", w3).alias("b_start"))
    w2 = Window.partitionBy(*who, "block").orderBy(F.col("turn").asc_nulls_first())
    turns = turns.select(F.struct(*who, "turn").alias("t_key"), F.struct(*who, "block").alias("b_key_"), running("t_times", w2).alias("t_segment"), running("t_chars", w2).alias("t_start"))
    turns = turns.join(blocks, F.col("b_key_") == F.col("b_key")).select("t_key", (F.col("t_segment") + F.col("b_segment")).alias("t_segment"), (F.col("t_start") + F.col("b_start")).alias("t_start"))
    w1 = Window.partitionBy(*who, "turn").orderBy(F.col("role").asc_nulls_first())
    each = each.select(F.struct(*who, "turn").alias("key"), "perspective", F.struct("conv.conv_id", "turn", "role").alias("p_seat"), running("times", w1).alias("r_segment"), running("chars", w1).alias("r_start"))
    placed = each.join(turns, F.col("key") == F.col("t_key")).select("p_seat", "perspective", (F.col("r_segment") + F.col("t_segment")).alias("p_segment"), (F.col("r_start") + F.col("t_start")).alias("p_start"))
    joined = said.join(placed, F.col("seat") == F.col("p_seat")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    role, perspective = F.col("seat.role"), F.col("perspective")
    head = header(role, perspective)
    lead = F.length(head).cast("long")
    length = lead + F.length("text") + len(CLOSE)
    joined = joined.withColumns({"lead": lead, "length": length, "start": F.col("p_start") + F.col("x_chars") + F.col("x_times") * (lead + len(CLOSE)) + F.col("copy") * length})
    masked = role == perspective
    return joined.select(
        F.col("seat.conv_id").alias("conv_id"),
        "perspective",
        (F.col("p_segment") + F.col("x_times") + F.col("copy")).alias("segment"),
        F.col("seat.turn").alias("turn"),
        role.alias("role"),
        F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"),
        "start",
        "length",
        F.when(masked, F.col("start") + F.col("lead")).otherwise(F.lit(-1).cast("long")).alias("loss_start"),
        F.when(masked, F.col("length") - F.col("lead")).otherwise(F.lit(0).cast("long")).alias("loss_length"),
    )


#: The same rows in DuckDB.
ORACLE_SQL = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM c WHERE role IS NOT NULL AND role <> 'system'),
h AS (SELECT c.conv_id, perspective, turn, role, text,
             '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role
                                    ELSE 'user name=' || coalesce(role, 'unknown') END || chr(10) AS head
      FROM c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, CAST(length(rendered) AS BIGINT) AS length,
             row_number() OVER o - 1 AS segment,
             CAST(coalesce(sum(length(rendered)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM r WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, perspective, segment, turn, role, rendered, start, length,
       CASE WHEN role = perspective THEN start + length(head) ELSE -1 END AS loss_start,
       CASE WHEN role = perspective THEN length - length(head) ELSE 0 END AS loss_length
FROM s
"""
