"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators.similarity import cosine_top_k
from brindle.plans.base import query, table

NEAR = """
WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q, vec_id AS id, label, round(list_dot_product(a, CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(a, a) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS score FROM q, embeddings WHERE vec_id <> q),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS wide FROM s QUALIFY wide <= {wide})
"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(NEAR.format(wide=10) + "SELECT q AS query, id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank, round(score, 6) AS score FROM r QUALIFY rank <= 10")
def knn_topk(spark, d):
    """The ten nearest by cosine of every hundredth vector, exactly."""
    all_ = vectors(spark, d)
    return cosine_top_k(all_, all_.filter("id % 100 = 0"), 10, oversample=1).withColumn("score", F.round("score", 6))


@query(NEAR.format(wide=10) + ", o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY q, label ORDER BY score DESC, id) = 1) SELECT q AS query, id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank, round(score, 6) AS score FROM o QUALIFY rank <= 5")
def knn_topk_dedup_label(spark, d):
    """Five at most, one of each label, from ten candidates."""
    all_ = vectors(spark, d)
    return cosine_top_k(all_, all_.filter("id % 100 = 0"), 5, oversample=2, one_per="label").withColumn("score", F.round("score", 6))


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY label")
def knowledge_base_stats(spark, d):
    """How many vectors of each type."""
    return vectors(spark, d).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))
