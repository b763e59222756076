"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotation import conversations

    return conversations(table(spark, sf_dir, "conversations"))


def op2_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import exact_top

    return exact_top(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op3_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, tokenize

    return pack(tokenize(table(spark, sf_dir, "documents"), word_vocabulary(), with_ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


#: A row's fold: labels are learned from rows where this isn't 0.
FOLD = "crc32(cast(doc_id as string)) % 5"


def op7_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), train=f"{FOLD} <> 0")
    return score(docs, model).select("doc_id", F.expr(f"{FOLD} = 0").alias("held_out"), "score", "predicted", "passages")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiindex import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op9_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), piece_vocabulary(), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Exact search over the same whole table, without an index.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_inner_product(q.c, p.c) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.c) = len(p.c)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    from . import quotation

    return {"op1_quotation_threads": quotation.SQL, "op2_cover_tree_search": OP2_SQL}
