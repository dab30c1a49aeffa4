"""Chat formatting by perspective rotation: every participant in turn is the assistant.

For each participant of a dialogue the whole dialogue is rendered with that speaker as `assistant`, all
other speakers as named users, and system messages as they are. A message is one row per perspective:
its rendered text, where it lies in the rendered dialogue, and the mask, that is the part a model
learns from: the content and the end mark of the assistant's own messages. Strung together by position,
the rows of a perspective are its dialogue.

A dialogue's order is (turn, speaker, text), missing turns last. Places are running totals. They are
summed within chunks of CHUNK turns, and over the chunks' totals, so that a dialogue of any length
is spread over many tasks. Participants are all speakers but `system`; a dialogue without any has
no rows. A null speaker is the participant `unknown`, a null text is empty, a null dialogue id is
one dialogue of its own, and repeated rows (equal in all four columns) count once. Marks that
occur inside a text are taken apart by a blank, so that they can't end a message. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
CHUNK = 512
START, END = "<|im_start|>", "<|im_end|>"

#: Header of a message, by the same SQL in Spark and DuckDB.
HEADER = (
    f"concat('{START}', CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN speaker = perspective"
    " THEN 'assistant' ELSE concat('user name=', speaker) END, chr(10))"
)
BODY = f"concat(replace(replace(coalesce(text, ''), '{START}', '<| im_start|>'), '{END}', '<| im_end|>'), '{END}', chr(10))"


def messages(turns: DataFrame, speaker: str = "role") -> DataFrame:
    """conv_id, turn, speaker, text and body of every message, each once."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce(speaker, F.lit(UNKNOWN)).alias("speaker"), "text"
    ).distinct()
    return rows.selectExpr("conv_id", "turn", "speaker", "text", f"{BODY} AS body")


def rotated(turns: DataFrame, speaker: str = "role", chunk: int = CHUNK) -> DataFrame:
    """conv_id, perspective, position, role, name, rendered, start, stop, mask_start and mask_stop
    of every message in every perspective; masks are empty where nothing is learned."""
    rows = messages(turns, speaker)
    people = rows.filter(F.col("speaker") != SYSTEM).select(
        F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective")
    )
    rows = rows.join(people.distinct(), F.expr("conv_id <=> p_conv"))
    rows = rows.selectExpr(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "text",
        f"turn div {chunk} AS chunk",
        f"{HEADER} AS header",
        "body",
    ).withColumn("size", F.expr("bigint(length(header) + length(body))"))
    dialogue = ["conv_id", "perspective"]
    order = [F.asc_nulls_last("turn"), "speaker", F.asc_nulls_first("text")]
    inside = Window.partitionBy(*dialogue, "chunk").orderBy(*order)
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {"own_position": F.row_number().over(inside), "own_stop": F.sum("size").over(until)}
    )
    before = Window.partitionBy(*dialogue).orderBy(F.asc_nulls_last("chunk"))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*dialogue, "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        .select(
            F.col("conv_id").alias("t_conv"),
            F.col("perspective").alias("t_perspective"),
            F.col("chunk").alias("t_chunk"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"),
        )
    )
    same = "conv_id <=> t_conv AND perspective = t_perspective AND chunk <=> t_chunk"
    rows = rows.join(totals, F.expr(same))
    mine = "speaker = perspective"
    return rows.selectExpr(
        "conv_id",
        "perspective",
        "n_before + own_position - 1 AS position",
        f"CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN {mine} THEN 'assistant' ELSE 'user' END AS role",
        f"CASE WHEN speaker <> '{SYSTEM}' AND NOT {mine} THEN speaker END AS name",
        "concat(header, body) AS rendered",
        "size_before + own_stop - size AS start",
        "size_before + own_stop AS stop",
        f"size_before + own_stop - CASE WHEN {mine} THEN length(body) ELSE 0 END AS mask_start",
        f"size_before + own_stop - CASE WHEN {mine} THEN 1 ELSE 0 END AS mask_stop",
    )


SQL = f"""
WITH m AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> '{SYSTEM}'
), r AS (
  SELECT m.*, perspective, {HEADER} AS header, {BODY} AS body
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), t AS (
  SELECT *, length(header) + length(body) AS size,
    row_number() OVER w AS n, CAST(sum(length(header) + length(body)) OVER w AS BIGINT) AS stop
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective
    ORDER BY turn NULLS LAST, speaker, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, n - 1 AS position,
  CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN speaker <> '{SYSTEM}' AND speaker <> perspective THEN speaker END AS name,
  concat(header, body) AS rendered, stop - size AS start, stop,
  stop - CASE WHEN speaker = perspective THEN length(body) ELSE 0 END AS mask_start,
  stop - CASE WHEN speaker = perspective THEN 1 ELSE 0 END AS mask_stop
FROM t
"""
