"""Topics from document embeddings: clusters, sizes, selection, terms and examples."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import fixed_values as fv
from lexmill.functions.ngrams import word_ngrams
from lexmill.functions.text import let
from lexmill.operators.select import first_per_group, in_set, sample_per_group
from lexmill.session import measured, written


def unit_vector(c: Column) -> Column:
    """A vector scaled to unit length; a zero vector stays zero."""
    values = c.cast("array<double>")
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))
    scaled = let(
        F.struct(values.alias("v"), length.alias("l")),
        lambda s: F.when(s["l"] > 0, F.transform(s["v"], lambda x: x / s["l"])).otherwise(s["v"]),
    )
    return scaled


def unit_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, unit_vector(F.col(column)))


def renumber_clusters(
    df: DataFrame, cluster_col: str = "cluster", min_size: int = fv.TOPIC_MIN_SIZE
) -> DataFrame:
    """Number clusters from 0 by falling size; those under ``min_size`` become noise."""
    sizes = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_n"))
    valid = (F.col("_n") >= min_size) & (F.col(cluster_col) != fv.NOISE_TOPIC)
    number = F.row_number().over(Window.orderBy(F.desc("_n"), cluster_col)) - 1
    ids = measured(sizes.filter(valid).select(cluster_col, number.alias("_new")))
    return (
        df.join(ids, cluster_col, "left")
        .withColumn(cluster_col, F.coalesce("_new", F.lit(fv.NOISE_TOPIC)))
        .drop("_new")
    )


def cluster_documents(
    df: DataFrame,
    k: int,
    column: str = "embedding",
    cluster_col: str = "cluster",
    min_size: int = fv.TOPIC_MIN_SIZE,
    max_iter: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Group documents by the direction of their embedding.

    Null and zero embeddings have none and are noise.
    """
    directed = F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))
    vectors = df.filter(directed).withColumn(
        "_vector", array_to_vector(F.col(column).cast("array<double>"))
    )
    model = KMeans(
        k=k,
        featuresCol="_vector",
        predictionCol=cluster_col,
        distanceMeasure="cosine",
        maxIter=max_iter,
        seed=seed,
    ).fit(vectors)
    rest = df.filter(~directed).withColumn(cluster_col, F.lit(fv.NOISE_TOPIC))
    grouped = model.transform(vectors).drop("_vector").unionByName(rest)
    return renumber_clusters(grouped, cluster_col, min_size)


def topic_info(df: DataFrame, topic_col: str = "cluster") -> DataFrame:
    """Documents per topic, noise first: ``topic, count``."""
    return (
        df.groupBy(F.col(topic_col).alias("topic"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("topic")
    )


def _head_and_tail(
    info: DataFrame, head: int, min_count: int, tail: int
) -> tuple[DataFrame, DataFrame]:
    first = info.filter(F.col("topic") != fv.NOISE_TOPIC).orderBy("topic").limit(head)
    last = info.filter(F.col("count") >= min_count).orderBy(F.desc("topic")).limit(tail)
    return first, last


def select_topics(
    info: DataFrame,
    head: int = fv.TOPIC_HEAD,
    min_count: int = fv.TOPIC_MIN_COUNT,
    tail: int = fv.TOPIC_TAIL,
) -> DataFrame:
    """The first topics and the last ones of sufficient size: ``topic``.

    Noise is no first topic but may be among the last.
    """
    first, last = _head_and_tail(info, head, min_count, tail)
    return first.select("topic").union(last.select("topic")).distinct()


def topic_coverage(
    info: DataFrame,
    head: int = fv.TOPIC_HEAD,
    min_count: int = fv.TOPIC_MIN_COUNT,
    tail: int = fv.TOPIC_TAIL,
) -> DataFrame:
    """Documents in the first and in the last topics, added up: ``rows, topics``.

    A topic in both lists counts twice in ``rows`` and once in ``topics``.
    """
    first, last = _head_and_tail(info, head, min_count, tail)
    return first.union(last).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
        F.count_distinct("topic").alias("topics"),
    )


def topic_terms(
    df: DataFrame, topic_col: str = "topic", text_col: str = "text", top: int = fv.TOPIC_TERMS
) -> DataFrame:
    """Highest class-based TF-IDF terms per topic: ``topic, term, weight``.

    weight = tf(t, c) / words(c) * ln(1 + A / f(t)), with A the mean number of words per
    topic (Grootendorst 2022). Counts are combined map-side; past the first shuffle there
    is one row per topic and term.
    """
    words = word_ngrams(df, text_col, [topic_col], 1)
    counts = words.groupBy(F.col(topic_col).alias("topic"), "term").agg(
        F.count(F.lit(1)).alias("n")
    )
    # needed for the totals and again for the weights; much smaller than the texts
    counts = written(counts, "topic_counts")
    sizes = measured(counts.groupBy("topic").agg(F.sum("n").alias("words")))
    mean = sizes.agg(F.avg("words")).scalar()
    overall = F.sum("n").over(Window.partitionBy("term"))
    weighed = (
        counts.withColumn("f", overall)
        .join(sizes, "topic")
        .select(
            "topic",
            "term",
            (F.col("n") / F.col("words") * F.log(F.lit(1.0) + mean / F.col("f"))).alias("weight"),
        )
    )
    return first_per_group(weighed, "topic", top, F.desc("weight"), "term")


def topic_examples(
    df: DataFrame, topic_col: str, order_by: str, n: int = 10
) -> DataFrame:
    """The first ``n`` documents of every topic."""
    return first_per_group(df, topic_col, n, order_by)


def topic_sample(
    df: DataFrame, topic_col: str, id_col: str, n: int = 20, seed: int = 42
) -> DataFrame:
    """A repeatable sample of every topic."""
    return sample_per_group(df, topic_col, n, id_col, seed)


def rows_of_topics(df: DataFrame, selected: DataFrame, topic_col: str = "cluster") -> DataFrame:
    return in_set(df, topic_col, selected.withColumnRenamed("topic", topic_col))
