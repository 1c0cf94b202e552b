"""Vector retrieval by cosine distance with dates, topics and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOPICS = 1000


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine; null where a vector is null or of length 0."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(a: str) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm))


def by_topic_and_age(chunks: DataFrame, topics: DataFrame, buckets: list[tuple[int, int, int, int]], within: tuple[str, ...] = ()) -> DataFrame:
    """The nearest chunks of every topic in every age bucket (bucket, least age, greatest age, k), for each value of the columns ``within``.

    Ages on an edge belong to both buckets; a chunk then stays with its first topic and bucket only.
    topics: (topic, q) of a stated set of at most TOPICS rows, which is broadcast; chunks: (id, age, embedding).
    """
    if topics.limit(TOPICS + 1).count() > TOPICS:
        raise ValueError(f"more than {TOPICS} topics")
    spread = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("bucket", "lo", "hi", "k"), b)]) for b in buckets])
    aged = chunks.select(*within, "id", "age", "embedding", F.explode(F.filter(spread, lambda b: F.col("age").between(b["lo"], b["hi"]))).alias("b"))
    rows = aged.crossJoin(F.broadcast(topics)).select(*within, "topic", "id", F.col("b.bucket").alias("bucket"), F.col("b.k").alias("k"), F.round(cosine_distance("embedding", "q"), 6).alias("distance"))
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*within, "topic", "bucket").orderBy("distance", "id"))).where("rank <= k")
    first = F.row_number().over(Window.partitionBy(*within, "id").orderBy("topic", "bucket"))
    return near.withColumn("seen", first).where("seen = 1").select(*within, "topic", "bucket", "id", "distance")
