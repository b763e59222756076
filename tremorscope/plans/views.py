"""The star-schema test tables seen as score records, responses, annotations, promotions and a ledger.

Each view comes twice: as a DataFrame, and as the text of a common table expression for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = "likert5"
LAST = 19  # a cell's last repeat
ESTIMATION = list(range(1, LAST + 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of ``lineitem`` with its environment, item, system and repeat.

    The lines of an environment, a part's class and a supplier's class are counted; every twenty of them are the
    repeats of one item more, so cells stay small and no line is left out, however large the table is.
    """
    t = table(spark, sf_dir, "lineitem")
    by = Window.partitionBy("env_id", "part", "s").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = t.withColumns({"env_id": F.concat(F.lit("e_"), "l_returnflag", "l_linestatus"), "part": F.col("l_partkey") % 25, "s": F.col("l_suppkey") % 4}).withColumn("n", F.row_number().over(by).cast("long") - 1)
    item = F.format_string("i_%04d", F.col("part") + 25 * F.floor(F.col("n") / (LAST + 1)))
    return rows.withColumns({"item_id": item, "system_id": F.concat(F.lit("s_"), "s"), "repeat_idx": F.col("n") % (LAST + 1)})


def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """env_id, item_id, system_id, repeat_idx, score, paraphrase_id."""
    score = (1 + (F.round(F.col("l_discount") * 100).cast("long") + F.col("l_quantity").cast("long")) % 5).cast("double")
    return _lines(spark, sf_dir).select("env_id", "item_id", "system_id", "repeat_idx", score.alias("score"), F.concat(F.lit("pp_"), F.col("repeat_idx") % 4).alias("paraphrase_id"))


LINES = """lines AS (
  SELECT * EXCLUDE (n, part), printf('i_%04d', part + 25 * (n // 20)) AS item_id, n % 20 AS repeat_idx
  FROM (
    SELECT *, 'e_' || l_returnflag || l_linestatus AS env_id, l_partkey % 25 AS part, l_suppkey % 4 AS s,
           row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_partkey % 25, l_suppkey % 4
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS n
    FROM lineitem
  )
)"""

RECORDS = LINES + """, score_records AS (
  SELECT env_id, item_id, 's_' || s AS system_id, repeat_idx, CAST(1 + (CAST(round(l_discount * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) % 5 AS DOUBLE) AS score, 'pp_' || (repeat_idx % 4) AS paraphrase_id
  FROM lines
)"""


def signal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with system, paraphrase and interaction effects, in steps of a quarter."""
    system = F.substring("system_id", 3, 9).cast("int")
    shift = 0.5 * system + 0.25 * (F.col("repeat_idx") % 4) + 0.25 * ((system + F.col("repeat_idx")) % 2)
    return score_records(spark, sf_dir).withColumn("score", F.col("score") + shift)


SIGNAL = RECORDS + """, signal_records AS (
  SELECT env_id, item_id, system_id, repeat_idx, paraphrase_id,
         score + 0.5 * CAST(substr(system_id, 3) AS INTEGER) + 0.25 * (repeat_idx % 4) + 0.25 * ((CAST(substr(system_id, 3) AS INTEGER) + repeat_idx) % 2) AS score
  FROM score_records
)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """env_id, order, line, response: seven kinds of judge answers."""
    t = table(spark, sf_dir, "lineitem")
    score = (1 + (F.round(F.col("l_discount") * 100).cast("long") + F.col("l_quantity").cast("long")) % 5).cast("string")
    k = F.col("l_linenumber") % 7
    text = (
        F.when(k == 0, F.concat(F.lit('{"score": '), score, F.lit("}")))
        .when(k == 1, F.concat(F.lit("Score: "), score))
        .when(k == 2, F.concat(score, F.lit("/5")))
        .when(k == 3, F.concat(F.lit("I would say "), score))
        .when(k == 4, F.lit("I cannot judge this."))
        .when(k == 5, F.lit("Rating: 9"))
        .otherwise(F.concat(score, F.lit(" out of 5, though 2 of 3 parts are weak")))
    )
    return t.select(F.concat(F.lit("e_"), "l_returnflag", "l_linestatus").alias("env_id"), "l_orderkey", "l_linenumber", text.alias("response"))


RESPONSES = """responses AS (
  SELECT 'e_' || l_returnflag || l_linestatus AS env_id, l_orderkey, l_linenumber,
         CASE l_linenumber % 7 WHEN 0 THEN '{"score": ' || s || '}' WHEN 1 THEN 'Score: ' || s WHEN 2 THEN s || '/5' WHEN 3 THEN 'I would say ' || s
           WHEN 4 THEN 'I cannot judge this.' WHEN 5 THEN 'Rating: 9' ELSE s || ' out of 5, though 2 of 3 parts are weak' END AS response
  FROM (SELECT *, CAST(1 + (CAST(round(l_discount * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) % 5 AS VARCHAR) AS s FROM lineitem)
), parsed AS (
  SELECT *, CASE WHEN s BETWEEN 1 AND 5 THEN s END AS parsed_score FROM (
    SELECT *, TRY_CAST(coalesce(
      nullif(regexp_extract(response, '^\\{"score": (\\d+)\\}$', 1), ''), nullif(regexp_extract(response, '(?i)(?:score|rating): (\\d+)', 1), ''),
      nullif(regexp_extract(response, '(\\d+) ?(?:/|out of ?)5', 1), ''), nullif(regexp_extract(response, '^[^0-9]*(\\d+)[^0-9]*$', 1), '')) AS DOUBLE) AS s
    FROM responses)
)"""


def annotations(spark: SparkSession, sf_dir: str, signal: bool = True) -> DataFrame:
    """item_id, system_id, facet, value from 1 to 5; with a system's effect if ``signal``."""
    means = _lines(spark, sf_dir).groupBy("item_id", "s").agg(
        F.round(1 + 4 * F.avg("l_discount") / 0.1, 9).alias("coherence"), F.round(1 + 4 * F.avg("l_extendedprice") / 100000, 9).alias("consistency"), F.round(1 + 4 * F.avg("l_quantity") / 50, 9).alias("fluency"), F.round(1 + 4 * F.avg("l_tax") / 0.08, 9).alias("relevance")
    )
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("coherence", "consistency", "fluency", "relevance"))))
    return means.select("item_id", F.concat(F.lit("s_"), "s").alias("system_id"), "s", each.alias("x")).select("item_id", "system_id", "x.facet", (F.col("x.value") + (0.5 * F.col("s") if signal else 0.0)).alias("value"))


ANNOTATIONS = """annotated AS (
  SELECT item_id, s, round(1 + 4 * avg(l_discount) / 0.1, 9) AS coherence,
         round(1 + 4 * avg(l_extendedprice) / 100000, 9) AS consistency, round(1 + 4 * avg(l_quantity) / 50, 9) AS fluency, round(1 + 4 * avg(l_tax) / 0.08, 9) AS relevance
  FROM lines GROUP BY ALL
), annotations AS (
  SELECT item_id, 's_' || s AS system_id, facet, value + 0.5 * s AS value FROM (UNPIVOT annotated ON coherence, consistency, fluency, relevance INTO NAME facet VALUE value)
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, promo_idx, question_id, base, transform."""
    t = table(spark, sf_dir, "orders")
    return t.groupBy((F.col("o_custkey") % 5).alias("seed"), (F.month("o_orderdate") % 6).cast("long").alias("promo_idx"), (F.col("o_orderkey") % 100).alias("question_id")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("base"), F.bool_or(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("transform"))


ANSWERS = """answers AS (
  SELECT o_custkey % 5 AS seed, CAST(month(o_orderdate) % 6 AS BIGINT) AS promo_idx, o_orderkey % 100 AS question_id,
         bool_or(o_orderstatus = 'F') AS base, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS transform
  FROM orders GROUP BY ALL
), counts AS (
  SELECT seed, promo_idx, count(*) FILTER (WHERE NOT base AND transform) AS b, count(*) FILTER (WHERE base AND NOT transform) AS c, count(*) AS n_questions, avg(CAST(base AS INTEGER)) AS baseline_accuracy
  FROM answers GROUP BY ALL
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiment, calls, cost_usd in whole cents."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("experiment"), (F.col("o_orderkey") % 50 + 1).alias("calls"), (F.round(F.col("o_totalprice")).cast("long") / 100).alias("cost_usd"))


LEDGER = "ledger AS (SELECT o_orderpriority AS experiment, o_orderkey % 50 + 1 AS calls, CAST(round(o_totalprice) AS BIGINT) / 100 AS cost_usd FROM orders)"
