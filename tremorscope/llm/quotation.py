"""Operator 1: quotation linking for conversations.

A line's quote level is its number of leading ``>`` signs. A passage is a line; normalised (lower case, white space
collapsed) and hashed, every quoted passage of a message is joined to the first message of its conversation that
wrote it unquoted. A message's parent is the earlier message that most of its level-1 passages come from (ties: the
later one); deeper levels only count where no passage of a lower level is found. Following parents gives a message's
thread; messages without a parent begin one. Conversations are ordered by thread, then turn, so that a reply never
stands before what it answers, and carry their text without quotes and without the line that introduces them.

Null and empty texts have no passages. A null conversation or turn links to nothing and is a thread of its own.
Repeated rows come out as often as they came in, next to each other. Further columns aren't read. An empty table
gives no rows. Nothing gathers a conversation in one task: parents are followed by doubling, and positions come from
range partitions and their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

QUOTED = r"^[ \t]*(>[ \t]?)+"
#: A line before a quote that ends so introduces it.
INTRODUCES = r"(?i)(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$"


def level(line: Column) -> Column:
    """The number of leading > signs of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    """A line without its signs, in lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, QUOTED, ""), r"[ \t\r\f]+", " ")))


def unquoted(text: Column) -> Column:
    """A text without quoted lines and without the lines that introduce them."""
    lines = F.split(text, "\n")

    def keep(line: Column, k: Column) -> Column:
        introduced = line.rlike(INTRODUCES) & F.coalesce(F.get(lines, k + 1).rlike(QUOTED), F.lit(False))
        return ~line.rlike(QUOTED) & ~introduced

    plain = F.regexp_replace(F.array_join(F.filter(lines, keep), "\n"), r"^\n+|\n+$", "")
    return F.when(text.rlike(r"(^|\n)[ \t]*>"), plain).otherwise(text)


def link(messages: DataFrame) -> DataFrame:
    """Per message with a parent: conv_id, turn, parent_turn."""
    lines = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    passages = lines.select("conv_id", "turn", level(F.col("line")).alias("level"), F.xxhash64(normal(F.col("line"))).alias("passage"), (F.length(normal(F.col("line"))) > 0).alias("some")).where("some")
    origins = passages.where("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("origin"))
    quotes = passages.where("level > 0").groupBy("conv_id", "passage", "turn", "level").agg(F.count("*").alias("times"))
    found = quotes.join(origins, ["conv_id", "passage"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("times").alias("votes"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "votes", "origin")).alias("best")).select("conv_id", "turn", F.col("best.origin").alias("parent_turn"))


def threads(parents: DataFrame) -> DataFrame:
    """Per message with a parent: its thread's first turn and its depth, by pointer doubling."""
    now = cut(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("at"), F.lit(1).cast("long").alias("depth")))
    if not now.head(1):
        return now.select("conv_id", "turn", "parent_turn", F.col("at").alias("thread_turn"), "depth")
    while True:
        up = now.select("conv_id", F.col("turn").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        joined = cut(now.join(up, ["conv_id", "at"], "left").select("conv_id", "turn", "parent_turn", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if not joined.where("moved").head(1):
            return joined.select("conv_id", "turn", "parent_turn", F.col("at").alias("thread_turn"), "depth")
        now = joined.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, position, turn, role, thread_turn, parent_turn, depth, n_quoted, max_level, text."""
    own = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    linked = threads(link(own))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(QUOTED)), level)
    # passages are joined on ids alone; the texts move once, in the order of the result
    read = own.withColumns({"levels": F.coalesce(lines, F.array().cast("array<int>")), "text": F.coalesce(unquoted(F.col("text")), F.lit(""))})
    rows = read.join(linked, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.coalesce("thread_turn", "turn").alias("thread_turn"), "parent_turn", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.size("levels").cast("long").alias("n_quoted"), F.coalesce(F.array_max("levels"), F.lit(0)).alias("max_level"), "text")
    order = ["conv_id", "thread_turn", "turn", "role", "text"]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("row"))
    placed = dealt.withColumn("inside", inside).join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return placed.select("conv_id", (F.col("start") + F.col("inside") - 1).alias("position"), "turn", "role", "thread_turn", "parent_turn", "depth", "n_quoted", "max_level", "text")


#: The same over the same table for DuckDB.
SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
split AS (SELECT id, conv_id, turn, string_split(text, chr(10)) AS ls FROM m WHERE text IS NOT NULL),
lines AS (SELECT id, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS k, ls FROM split),
marked AS (
  SELECT id, conv_id, turn, line, k, len(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]?)+'), '[^>]', '', 'g')) AS level,
         lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]?)+', ''), '[ \t\r\f]+', ' ', 'g'))) AS norm,
         coalesce(regexp_matches(ls[k + 1], '^[ \t]*(>[ \t]?)+'), FALSE) AS before_quote
  FROM lines
),
passages AS (SELECT * FROM marked WHERE norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
origins AS (SELECT conv_id, norm, min(turn) AS origin FROM passages WHERE level = 0 GROUP BY ALL),
votes AS (SELECT p.conv_id, p.turn, p.level, o.origin, count(*) AS votes FROM passages p JOIN origins o ON p.conv_id = o.conv_id AND p.norm = o.norm AND o.origin < p.turn WHERE p.level > 0 GROUP BY ALL),
parents AS (SELECT conv_id, turn, origin AS parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, origin DESC) AS r FROM votes) WHERE r = 1),
up AS (
  SELECT conv_id, turn, parent_turn AS above, 1 AS depth FROM parents
  UNION ALL SELECT u.conv_id, u.turn, p.parent_turn, u.depth + 1 FROM up u JOIN parents p ON u.conv_id = p.conv_id AND u.above = p.turn
),
roots AS (SELECT conv_id, turn, min(above) AS thread_turn, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY ALL),
plain AS (
  SELECT id, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE level = 0 AND NOT (before_quote AND regexp_matches(line, '(?i)(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$'))) AS kept,
         count(*) FILTER (WHERE level > 0) AS n_quoted, max(level) AS max_level
  FROM marked GROUP BY id
)
SELECT m.conv_id, CAST(row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(r.thread_turn, m.turn), m.turn, m.role, CASE WHEN n_quoted > 0 THEN trim(coalesce(kept, ''), chr(10)) ELSE coalesce(m.text, '') END) - 1 AS BIGINT) AS position,
       m.turn, m.role, coalesce(r.thread_turn, m.turn) AS thread_turn, p.parent_turn, coalesce(r.depth, 0) AS depth,
       coalesce(n_quoted, 0) AS n_quoted, CAST(coalesce(max_level, 0) AS INTEGER) AS max_level,
       CASE WHEN n_quoted > 0 THEN trim(coalesce(kept, ''), chr(10)) ELSE coalesce(m.text, '') END AS text
FROM m LEFT JOIN plain USING (id) LEFT JOIN parents p ON m.conv_id = p.conv_id AND m.turn = p.turn LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn
"""
