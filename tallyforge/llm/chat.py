"""Multi-party chat: each dialogue rendered from every participant's perspective."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import common

#: Roles that set the scene: they keep their role, and no perspective is theirs.
CONTEXT = ("system", "tool", "function")
START, END = "<|im_start|>", "<|im_end|>\n"
#: How a marker inside a content or a name is written, so that no turn can be forged.
MARKER, ESCAPED = "<|im_", "<\\|im_"
#: Turns that are ordered together; a longer dialogue is spread over several tasks.
STRETCH = 64


def _escaped(c):
    return F.replace(c, F.lit(MARKER), F.lit(ESCAPED))


def rotate(conversations: DataFrame) -> DataFrame:
    """Renders conversations(conv_id, turn, role, text) once for every participant.

    Each participant's rendering shows that speaker as assistant, the others as users that
    carry their name, and context roles as they are. One row for each perspective and turn:
    conv_id, perspective, turn, position (from 0), speaker, role, segment (the rendered turn),
    segment_start, content_start, content_end (code points in the whole rendering, which is
    the segments by position) and mask: true where the content is the assistant's, the part
    to learn from.

    Markers in contents and names are written with a backslash (ESCAPED), line feeds in names
    as spaces; perspective and speaker stay as they are. Offsets count what is rendered.

    Turns are ordered by turn, then speaker, then text; a null comes last. Repeated turns
    all stay. Null text: empty. Null role: an unnamed user, no perspective. A dialogue
    without participants has one rendering with a null perspective and no mask. Null
    conv_id: a dialogue like any other. No rows: none out. Other columns are ignored.

    A dialogue is never gathered: stretches of STRETCH turn numbers are ordered by
    themselves and placed by the sums of the stretches before them.
    """
    turns = conversations.select(
        F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("speaker"), _escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("content")
    ).withColumn("stretch", F.floor(F.col("turn") / STRETCH).cast("long"))
    speaking = turns.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*CONTEXT)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    stretches = turns.select("conv_id", "stretch").distinct()
    viewed = stretches.join(speaking, stretches["conv_id"].eqNullSafe(speaking["c"]), "left").select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), "perspective")
    rows = turns.join(viewed, turns["conv_id"].eqNullSafe(viewed["c"]) & turns["stretch"].eqNullSafe(viewed["s"])).drop("c", "s")

    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.col("speaker").isin(*CONTEXT), F.col("speaker")).otherwise("user")
    head = F.concat(F.lit(START), role, F.when(own | F.col("speaker").isNull() | F.col("speaker").isin(*CONTEXT), F.lit("\n")).otherwise(F.concat(F.lit(" name="), F.replace(_escaped(F.col("speaker")), F.lit("\n"), F.lit(" ")), F.lit("\n"))))
    shown = rows.withColumns({"mask": own, "shown_role": role, "head": head}).withColumn("chars", (F.length("head") + F.length("content") + len(END)).cast("long"))

    view = ("conv_id", "perspective")
    sums = shown.groupBy(*view, "stretch").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("sum_chars"))
    earlier = Window.partitionBy(*view).orderBy(F.col("stretch").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(*(F.col(c).alias(f"b_{c}") for c in (*view, "stretch")), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum_chars").over(earlier), F.lit(0)).alias("chars_before"))

    within = Window.partitionBy(*view, "stretch").orderBy(F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), "content")
    placed = shown.withColumns({"nth": F.row_number().over(within), "upto": F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    same = [placed[c].eqNullSafe(begun[f"b_{c}"]) for c in (*view, "stretch")]
    start = F.col("chars_before") + F.col("upto") - F.col("chars")
    content_start = start + F.length("head")
    return placed.join(begun, same[0] & same[1] & same[2]).select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("n_before") + F.col("nth") - 1).alias("position"),
        "speaker",
        F.col("shown_role").alias("role"),
        F.concat("head", "content", F.lit(END)).alias("segment"),
        start.alias("segment_start"),
        content_start.alias("content_start"),
        (content_start + F.length("content")).alias("content_end"),
        "mask",
    )


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(common.table(spark, sf_dir, "conversations"))


_IN = ", ".join(f"'{c}'" for c in CONTEXT)
ORACLE_SQL = f"""
    WITH t AS (SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '{MARKER}', '{ESCAPED}') AS content FROM conversations),
    p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker NOT IN ({_IN})),
    r AS (SELECT t.*, perspective, coalesce(speaker = perspective, false) AS mask FROM t LEFT JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    h AS (SELECT *, CASE WHEN mask THEN 'assistant' WHEN speaker IN ({_IN}) THEN speaker ELSE 'user' END AS role,
        CASE WHEN mask OR speaker IS NULL OR speaker IN ({_IN}) THEN '' ELSE ' name=' || replace(replace(speaker, '{MARKER}', '{ESCAPED}'), chr(10), ' ') END AS name FROM r),
    s AS (SELECT *, '{START}' || role || name || chr(10) AS head FROM h),
    g AS (SELECT *, head || content || '{END.strip()}' || chr(10) AS segment FROM s)
    SELECT conv_id, perspective, turn, row_number() OVER w - 1 AS position, speaker, role, segment,
        (sum(length(segment)) OVER w - length(segment))::BIGINT AS segment_start, (sum(length(segment)) OVER w - length(segment) + length(head))::BIGINT AS content_start,
        (sum(length(segment)) OVER w - length(segment) + length(head) + length(content))::BIGINT AS content_end, mask
    FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS LAST, content ROWS UNBOUNDED PRECEDING)
"""
