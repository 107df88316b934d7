"""The registered queries: one per operator, each over its whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill import fixed_values as fv
from lexmill.functions import text as tx
from lexmill.functions.ngrams import char_ngrams, word_ngrams
from lexmill.operators import dedup, evaluate, hierarchy, labels, select, splits, svm, tfidf, topics
from lexmill.operators.classifier import (
    Settings,
    TopicClassifier,
    TopicClassifierModel,
    draws,
    fit_flat,
    predict_flat,
    tune,
)
from lexmill.operators.search import drawn_terms
from lexmill.session import dealt, new_folder, spread, task_count, wide_rows, written
from lexmill.sources import tables
from lexmill.sources.bundle import load_bundle, save_bundle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under the function's name without its trailing ``_``."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# --- inputs ------------------------------------------------------------------------

DOCUMENT_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{sf}/documents.parquet")


def spread_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(documents(spark, sf), "doc_id")


def split_of(id_col: str = "doc_id") -> Column:
    last = F.col(id_col) % 10
    return F.when(last == 0, "test").when(last == 1, "validation").otherwise("train")


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf).withColumn("split", split_of())


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label made of language and quality, and a split."""
    marks = table(spark, sf, "labels").select("doc_id", "quality")
    label = F.concat_ws("_", "lang", "quality")
    return (
        spread_documents(spark, sf)
        .join(marks, "doc_id")
        .select("doc_id", "text", "source", label.alias("label"), split_of().alias("split"))
    )


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as truth and a rule as prediction; one predicted label is never true."""
    guess = (
        F.when(F.col("doc_id") % 11 == 0, "xx")
        .when(F.col("doc_id") % 7 == 0, "en")
        .otherwise(F.col("lang"))
    )
    return documents(spark, sf).select(F.col("lang").alias("label"), guess.alias("pred"))


def clustered_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    cluster = F.when(F.col("vec_id") % 11 == 0, fv.NOISE_TOPIC).otherwise(F.col("label"))
    return table(spark, sf, "embeddings").select("vec_id", "embedding", cluster.alias("cluster"))


CONFIG = tfidf.TfidfConfig()
TOPIC_LIMITS = {"head": 4, "min_count": 45, "tail": 3}
# all defaults but those that follow the size of the tables
SETTINGS = Settings(min_bucket_size=30, n_clusters=3)


# --- flagship ------------------------------------------------------------------------


@query
def deduplicated_share(spark: SparkSession, sf: str) -> DataFrame:
    """Normalise, keep one document per text, and report the share per language."""
    unique = dedup.drop_duplicates_normalized(
        spread_documents(spark, sf).select("doc_id", "text", "lang"),
        ["text"],
        tx.normalize_text,
        order_by=["doc_id"],
    )
    share = labels.label_share(unique, "lang")
    return share.withColumn("percent", F.round("percent", 6))


# --- sources and sinks ---------------------------------------------------------------


@query
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_articles(spark, f"{sf}/documents.parquet", DOCUMENT_SCHEMA, "parquet")


@query
def scan_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Write three split files, then read them as one table."""
    parts = documents(spark, sf).select("doc_id", "text", "lang", split_of().alias("split"))
    folder = new_folder(spark, "splits")
    parts.write.partitionBy("split").parquet(folder)
    paths = {name: f"{folder}/split={name}" for name in tables.SPLITS}
    schema = StructType(parts.schema.fields[:3])
    return tables.read_splits(spark, paths, schema)


@query
def labelled_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a topic, written as CSV and read back."""
    names = {"en": "English", "fr": "French"}
    named = select.map_lookup(documents(spark, sf), "lang", names, "topic")
    folder = new_folder(spark, "labelled")
    tables.write_labelled(named, folder, ["doc_id", "text", "source"])
    schema = StructType(
        [StructField("doc_id", LongType()), *tables.text_schema(["text", "source", "topic"])]
    )
    return tables.read_articles(spark, folder, schema)


# --- projections, filters, lookups -------------------------------------------------------


@query
def text_label(spark: SparkSession, sf: str) -> DataFrame:
    both = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return select.text_label(both, "text", "quality", "doc_id")


@query
def combine_text(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    tag = (
        F.when(key % 5 == 0, " None ")
        .when(key % 7 == 0, "<NA>")
        .when(key % 3 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("  "), "p_brand"))
    )
    parts = table(spark, sf, "part").withColumn("tag1", tag)
    columns = ["p_name", *select.columns_with_prefix(parts), "absent", "p_type", "p_size"]
    return select.combine_text(parts, columns, " ", "combined").select("p_partkey", "combined")


@query
def non_empty(spark: SparkSession, sf: str) -> DataFrame:
    blanked = documents(spark, sf).withColumn(
        "text", F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("text"))
    )
    return select.non_empty(blanked, "text").select("doc_id", "text")


@query
def topic_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = clustered_embeddings(spark, sf)
    chosen = topics.select_topics(topics.topic_info(rows), **TOPIC_LIMITS)
    return topics.rows_of_topics(rows, chosen).select("vec_id", "cluster")


@query
def topic_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = clustered_embeddings(spark, sf).select("vec_id", "cluster")
    return select.map_lookup(rows, "cluster", fv.TOPIC_NAMES, "topic")


@query
def sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", "source")
    return select.sample_per_group(rows, "source", 10)


@query
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return select.distinct_values(documents(spark, sf), "source")


@query
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select(split_of().alias("split"))
    return select.row_count(rows, "split")


@query
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return select.preview(documents(spark, sf).select("doc_id", "text", "lang"), "doc_id", 5)


# --- text cleaning -----------------------------------------------------------------------


@query
def safe_str(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id") % 5
    raw = (
        F.when(key == 0, " NaN ")
        .when(key == 1, F.lit(None))
        .otherwise(F.concat(F.lit("\t "), "text", F.lit(" \n")))
    )
    return spread_documents(spark, sf).select("doc_id", tx.safe_str(raw).alias("out"))


@query
def fix_spaces(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(table(spark, sf, "pages"), "page_id")
    return pages.select("page_id", tx.fix_missing_spaces(F.col("html")).alias("out"))


@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(table(spark, sf, "pages"), "page_id")
    return pages.select("page_id", tx.normalize_text(F.col("html")).alias("out"))


@query
def normalize_phones(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    low, high = (F.lpad((key % m).cast("string"), 4, "0") for m in (9973, 7919))
    raw = F.when(
        key % 2 == 0, F.concat(F.lit("telp 0812-"), low, F.lit("-"), high, F.lit(" kantor"))
    ).otherwise(F.concat(F.lit("telp +62 812 "), low, F.lit(" "), high, F.lit(" kantor")))
    return table(spark, sf, "customer").select(
        "c_custkey", tx.normalize_phones(raw).alias("out")
    )


@query
def model_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text as the models see it: the missing word is empty, the rest is not stripped."""
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit(" nAn\n")).when(
        F.col("doc_id") % 5 != 1, F.concat(F.lit(" "), "text")
    )
    return spread_documents(spark, sf).select("doc_id", tx.model_text(raw).alias("out"))


@query
def python_text_fn(spark: SparkSession, sf: str) -> DataFrame:
    """A plain ``str -> str`` function in a chain of cleaners."""
    clean = tx.chain("normalize_text", tx.python_text_fn(lambda t: t[::-1]))
    return spread_documents(spark, sf).select("doc_id", clean(F.col("text")).alias("out"))


CUSTOM_STEPS = (
    ("apply", "[0-9]+", " # ", None),
    ("repeat", "^[A-Z][a-z]* ", "", 2),
)


@query
def clean_steps(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = tx.apply_steps(F.col("text"), CUSTOM_STEPS)
    return spread_documents(spark, sf).select("doc_id", cleaned.alias("out"))


@query
def clean_news(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id") % 4
    prefix = (
        F.when(key == 0, "KOMPAS - ")
        .when(key == 1, "JAKARTA – ")
        .when(key == 2, "Baca Selengkapnya ")
        .otherwise("")
    )
    raw = F.concat(prefix, "text")
    return spread_documents(spark, sf).select("doc_id", tx.clean_news(raw).alias("out"))


def _amounts() -> Column:
    number, kind = F.col("event_id").cast("string"), F.col("event_id") % 6
    shapes = (
        ("harga Rp ", " juta naik "),
        ("harga USD ", " naik "),
        ("harga $", " naik "),
        ("harga ", " persen naik "),
        ("harga ", " bps naik "),
    )
    built = F.when(kind == 5, F.concat(F.lit("beli $BBCA naik "), "event_type"))
    for i, (before, after) in enumerate(shapes):
        built = built.when(
            kind == i, F.concat(F.lit(before), number, F.lit(after), F.col("event_type"))
        )
    return built


@query
def mask_finance(spark: SparkSession, sf: str) -> DataFrame:
    events = dealt(table(spark, sf, "events"), "event_id", "event_type")
    return events.select("event_id", tx.mask_finance(_amounts()).alias("out"))


@query
def mask_numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(
        F.lit("nilai "), F.col("event_id").cast("string"), F.lit(" hari usd "), F.col("event_type")
    )
    masked = tx.mask_finance(raw, mask_numbers=True, keep_currency_words=False)
    events = dealt(table(spark, sf, "events"), "event_id", "event_type")
    return events.select("event_id", masked.alias("out"))


@query
def clean_chain(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("KOMPAS - "), _amounts()))
    cleaned = tx.chain("clean_news", "mask_finance")(raw)
    events = dealt(table(spark, sf, "events"), "event_id", "event_type")
    return events.select("event_id", cleaned.alias("out"))


# --- de-duplication ------------------------------------------------------------------------


@query
def dedup_within_first(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.dedup_within(
        spread_documents(spark, sf), ["doc_id"], key_fn=tx.normalize_text, keep="first"
    )
    return kept.select("doc_id", "text", "source")


@query
def dedup_within_last(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.dedup_within(
        spread_documents(spark, sf), ["doc_id"], key_fn=tx.normalize_text, keep="last"
    )
    return kept.select("doc_id", "text", "source")


@query
def dedup_splits(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.dedup_split_table(
        split_documents(spark, sf), ["doc_id"], key_fn=tx.normalize_text
    )
    return kept.select("doc_id", "text", "split")


@query
def dedup_splits_keep_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows whose key an earlier split holds go; copies inside a split stay."""
    kept = dedup.dedup_split_table(
        split_documents(spark, sf), ["doc_id"], key_fn=tx.normalize_text, within=False
    )
    return kept.select("doc_id", "text", "split")


@query
def dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_report(split_documents(spark, sf), key_fn=tx.normalize_text)


@query
def overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.overlap_counts(split_documents(spark, sf), key_fn=tx.normalize_text)


@query
def drop_dups_norm(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.drop_duplicates_normalized(
        spread_documents(spark, sf), ["text"], tx.normalize_text, ["doc_id"]
    )
    return kept.select("doc_id", "text", "lang")


@query
def drop_dups_multi(spark: SparkSession, sf: str) -> DataFrame:
    turns = spread(table(spark, sf, "conversations"), "conv_id")
    return dedup.drop_duplicates_normalized(
        turns, ["role", "text"], tx.normalize_text, ["conv_id", "turn"], keep="last"
    )


# --- labels and splits -----------------------------------------------------------------------


def _faulty_labels(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    label = (
        F.when(key % 7 == 0, F.lit(None))
        .when(key % 5 == 0, " ")
        .when(key % 11 == 0, "NaN")
        .otherwise(F.concat(F.lit(" "), "lang"))
    )
    return documents(spark, sf).select("doc_id", label.alias("label"))


@query
def invalid_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.invalid_labels(_faulty_labels(spark, sf))


@query
def label_is_integer(spark: SparkSession, sf: str) -> DataFrame:
    docs, parts = documents(spark, sf), table(spark, sf, "part")
    checks = {
        "whole": table(spark, sf, "labels").select(F.col("quality").alias("label")),
        "floating": docs.select(F.col("n_chars").cast("double").alias("label")),
        "price": parts.select(F.col("p_retailprice").alias("label")),
        "digits": docs.select((-F.col("doc_id")).cast("string").alias("label")),
        "words": docs.select(F.col("lang").alias("label")),
    }
    rows = [
        labels.label_is_integer(df).select(F.lit(name).alias("name"), "is_integer")
        for name, df in checks.items()
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query
def coerce_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.coerce_labels(_faulty_labels(spark, sf), as_str=True)


@query
def coerce_labels_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Whole floating labels become integers, rows without one go."""
    value = F.when(F.col("doc_id") % 6 == 0, F.lit(float("nan"))).when(
        F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")
    )
    docs = documents(spark, sf).select("doc_id", value.alias("label"))
    return labels.coerce_labels(docs, as_str=False)


@query
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.encode_labels(documents(spark, sf), "source")


@query
def label_support(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_support(labelled_documents(spark, sf))


@query
def label_share(spark: SparkSession, sf: str) -> DataFrame:
    share = labels.label_share(documents(spark, sf), "lang")
    return share.withColumn("percent", F.round("percent", 6))


@query
def label_by_split(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("doc_id") % 13 != 0, F.col("source"))
    rows = documents(spark, sf).select(label.alias("label"), split_of().alias("split"))
    return labels.label_by_split(rows)


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", F.col("lang").alias("label"))
    return splits.stratified_split(rows)


@query
def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", "text", split_of().alias("split"))
    return splits.union_splits(rows, "train", "validation")


# --- TF-IDF ----------------------------------------------------------------------------------


def _gram_digest(grams: DataFrame) -> DataFrame:
    """All n-grams of a document as one digest, to compare them in full."""
    return grams.select(
        "doc_id",
        F.size("terms").cast("long").alias("n_grams"),
        F.md5(F.array_join("terms", "|")).alias("digest"),
    )


def _by_document(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of each document id: texts are shuffled, n-grams are not."""
    docs = documents(spark, sf).select("doc_id", "text")
    parted = docs.repartition(task_count(spark), "doc_id")
    return parted.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


@query
def word_ngrams_(spark: SparkSession, sf: str) -> DataFrame:
    docs = _by_document(spark, sf)
    return _gram_digest(word_ngrams(docs, "texts", ["doc_id"], 2, listed=True))


@query
def char_ngrams_(spark: SparkSession, sf: str) -> DataFrame:
    docs = _by_document(spark, sf)
    return _gram_digest(char_ngrams(docs, "texts", ["doc_id"], listed=True))


@query
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all terms that pass the document frequency limits."""
    docs = documents(spark, sf)
    least = [CONFIG.limits(block)[0] for block in tfidf.BLOCKS]
    stats = written(tfidf.term_stats(docs, CONFIG.ngram_max, least=least), "stats")
    rows = docs.count()
    parts = []
    for block in tfidf.BLOCKS:
        min_df, max_df, _ = CONFIG.limits(block)
        of_block = stats.filter(F.col("block") == block)
        kept = tfidf.prune_terms(of_block, rows, min_df, max_df)
        parts.append(kept.select("block", "term", "df", "tf"))
    return parts[0].unionByName(parts[1])


@query
def vocab_topk(spark: SparkSession, sf: str) -> DataFrame:
    vocab = tfidf.fit_vocabulary(documents(spark, sf), CONFIG)
    return vocab.select("block", "term", "df", "tf", "idx")


@query
def idf(spark: SparkSession, sf: str) -> DataFrame:
    vocab = tfidf.fit_vocabulary(documents(spark, sf), CONFIG)
    return vocab.select("block", "term", F.round("idf", 6).alias("idf"))


def _features(df: DataFrame, *keys: str) -> DataFrame:
    vocab = tfidf.fit_vocabulary(df, CONFIG)
    return tfidf.tfidf_transform(df, vocab, CONFIG, ["doc_id", *keys])


@query
def tfidf_(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the word block."""
    docs = documents(spark, sf)
    vocab = tfidf.fit_vocabulary(docs, CONFIG)
    rows = tfidf.tfidf_transform(docs, vocab, CONFIG).filter(F.col("block") == tfidf.WORD_BLOCK)
    return rows.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_union(spark: SparkSession, sf: str) -> DataFrame:
    """Both blocks, summed up per document and block; the length of a block is 1."""
    weight = F.col("weight")
    return (
        _features(documents(spark, sf))
        .groupBy("doc_id", "block")
        .agg(
            F.count(F.lit(1)).alias("terms"),
            F.round(F.sum(weight), 6).alias("total"),
            F.round(F.max(weight), 6).alias("largest"),
            F.round(F.sum(weight * weight), 6).alias("length"),
            F.round(F.sum(weight * F.col("idx")), 3).alias("weighted_idx"),
        )
    )


@query
def tfidf_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out documents weighed with the vocabulary of the training split."""
    docs = documents(spark, sf).withColumn("split", split_of())
    vocab = tfidf.fit_vocabulary(docs.filter("split = 'train'"), CONFIG)
    rows = tfidf.tfidf_transform(docs.filter("split <> 'train'"), vocab, CONFIG)
    return rows.select("doc_id", "block", "term", F.round("weight", 6).alias("weight"))


# --- hierarchy ---------------------------------------------------------------------------------


def _centroids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = labelled_documents(spark, sf)
    support = labels.label_support(docs)
    return hierarchy.label_centroids(_features(docs, "label"), support), support


@query
def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    centroids, _ = _centroids(spark, sf)
    return centroids.withColumn("weight", F.round("weight", 6))


@query
def centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    distances = hierarchy.centroid_distance(*_centroids(spark, sf))
    return distances.withColumn("dist", F.round("dist", 6))


@query
def aggregate_map(spark: SparkSession, sf: str) -> DataFrame:
    docs = labelled_documents(spark, sf)
    return hierarchy.aggregate_map(_features(docs, "label"), labels.label_support(docs), 3)


def _given_clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = labelled_documents(spark, sf)
    support = labels.label_support(docs, min_support=15)
    codes = labels.encode_labels(support.filter("kept"))
    return docs, support, codes.select("label", (F.col("code") % 3).alias("cluster"))


@query
def rare_buckets(spark: SparkSession, sf: str) -> DataFrame:
    _, support, clusters = _given_clusters(spark, sf)
    return hierarchy.rare_buckets(support, clusters)


@query
def apply_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    docs, support, clusters = _given_clusters(spark, sf)
    kept = hierarchy.rare_buckets(support.filter("kept"), clusters)
    return hierarchy.apply_aggregate(docs.select("doc_id", "label"), kept)


# --- training and prediction ---------------------------------------------------------------------


@query
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = svm.balanced_weights(labelled_documents(spark, sf))
    return weights.withColumn("weight", F.round("weight", 6))


@query
def stage2_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    return svm.stage2_fallbacks(labelled_documents(spark, sf), "source", "label", 20)


def _class_scores(docs: DataFrame, classes: list[str], step: int) -> DataFrame:
    named = F.explode(F.array(*(F.struct(F.lit(i), F.lit(c)) for i, c in enumerate(classes))))
    rows = docs.withColumn("_c", named)
    score = (F.col("doc_id") * step + F.col("_c.col1") * 13) % 17
    return rows.select(
        *docs.columns, F.col("_c.col2").alias("class"), score.cast("double").alias("score")
    )


@query
def route_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Four aggregates: two with a classifier, one with a constant, one with neither."""
    docs = documents(spark, sf).select("doc_id")
    stage1 = _class_scores(docs, ["C0", "C1", "C10", "C2"], 7)
    served = docs.withColumn("aggregate", F.explode(F.array(F.lit("C0"), F.lit("C1"))))
    stage2 = _class_scores(served, ["a", "b", "c"], 5)
    constants = (
        documents(spark, sf)
        .groupBy(F.lit("C10").alias("aggregate"))
        .agg(F.min("lang").alias("fallback"))
    )
    return svm.route_predict(stage1, stage2, constants, ["doc_id"])


def _centroid_coefficients(docs: DataFrame, features: DataFrame) -> DataFrame:
    """Label centroids as coefficients, and a bias per class."""
    support = labels.label_support(docs)
    bias = support.select(
        F.col("label").alias("class"),
        F.lit(svm.BIAS).alias("idx"),
        (F.col("n") / 10000.0).alias("weight"),
    )
    centroids = hierarchy.label_centroids(features, support)
    named = centroids.withColumnRenamed("label", "class").unionByName(bias)
    return written(named, "coefficients")


@query
def score_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Linear scores with the label centroids as coefficients and a bias per class."""
    docs = labelled_documents(spark, sf)
    # two readers: weighing the texts again costs less than a row per term on disk
    features = _features(docs, "label").select("doc_id", "label", "idx", "weight")
    keys = ["doc_id"]
    return svm.score_argmax(
        features.select("doc_id", "idx", "weight"),
        docs.select("doc_id"),
        _centroid_coefficients(docs, features),
        keys,
    )


@query
def score_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores on packed documents, as the fitted models predict."""
    docs = labelled_documents(spark, sf)
    vocab = tfidf.fit_vocabulary(docs, CONFIG)
    packed = written(tfidf.packed_documents(docs, vocab, CONFIG), "packed")
    features = tfidf.tfidf_transform(docs, vocab, CONFIG, ["doc_id", "label"])
    coefficients = _centroid_coefficients(docs, features)
    scored = svm.best_of_stage(packed, coefficients, vocab.count(), ["doc_id"])
    return scored.select("doc_id", "pred")


def _fitted(spark: SparkSession, sf: str) -> TopicClassifierModel:
    classifier = TopicClassifier(("clean_news",), tuning=False, settings=SETTINGS)
    return classifier.fit(labelled_documents(spark, sf))


@query
def hier_fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the labelled documents, predict every document."""
    return _fitted(spark, sf).predict(spread_documents(spark, sf))


@query
def bundle_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a model before and after saving and loading it."""
    model = _fitted(spark, sf)
    again = load_bundle(spark, save_bundle(model, new_folder(spark, "bundle"), ["text"], "label"))
    docs = spread_documents(spark, sf)
    before = model.predict(docs).select("doc_id", F.col("pred").alias("before"))
    both = before.join(again.predict(docs), "doc_id", "full")
    differs = ~F.col("before").eqNullSafe(F.col("pred"))
    truth = labelled_documents(spark, sf).select("doc_id", "label")
    known = truth.select(F.col("label").alias("pred"), F.lit(True).alias("known")).distinct()
    checked = both.join(truth, "doc_id", "left").join(known, "pred", "left")
    right = F.count_if(F.col("label") == F.col("pred"))
    most = truth.groupBy("label").count().agg(F.max("count")).scalar()
    return checked.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(differs).alias("mismatches"),
        F.count("label").alias("labelled"),
        F.count_if(F.col("known").isNull()).alias("unknown_labels"),
        (right > most).alias("beats_majority"),
    )


@query
def flat_fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("split", split_of())
    train = docs.filter("split = 'train'")
    cfg = CONFIG
    vocab = tfidf.fit_vocabulary(train, cfg)
    size = vocab.count()
    # a text is weighed once: what was fitted on is read again to be predicted
    keys = ["doc_id", "lang", "split"]
    packed = written(tfidf.packed_documents(train, vocab, cfg, keys), "packed", wide=True)
    coefficients = fit_flat(packed, size, fv.DEFAULT_C, "lang", SETTINGS, stored=True)
    held = tfidf.packed_documents(docs.filter("split <> 'train'"), vocab, cfg, keys)
    found = predict_flat(packed.unionByName(held), coefficients, size, *keys)
    with wide_rows(spark):
        return written(found, "predicted")


@query
def svm_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Ten classes on the first two components of the embeddings, to the last digits."""
    rows = table(spark, sf, "embeddings").filter("label IS NOT NULL")
    documents_ = rows.select(
        F.col("label").cast("string").alias("label"),
        F.array(F.lit(0), F.lit(1)).alias("indices"),
        F.array(*(F.col("embedding")[i].cast("double") for i in (0, 1))).alias("values"),
    )
    exact = Settings(tol=1e-10)
    coefficients = fit_flat(documents_, 2, fv.DEFAULT_C, "label", exact)
    return coefficients.select("class", "idx", F.round("weight", 6).alias("weight"))


@query
def tune_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """The terms that each draw of the search keeps."""
    train = split_documents(spark, sf).filter("split = 'train'")
    drawn = draws(SETTINGS)
    stats = written(tfidf.term_stats(train, fv.SEARCH_NGRAM_MAX[1], least=(1, 2)), "stats")
    terms = drawn_terms(stats, train.count(), drawn)
    trial = F.explode(F.sequence(F.lit(0), F.lit(len(drawn) - 1))).alias("trial")
    held = terms.select("*", trial).filter(F.expr("shiftright(draws, trial) & 1 = 1"))
    return held.groupBy("trial", "block").agg(
        F.count(F.lit(1)).alias("terms"),
        F.sum("df").alias("sum_df"),
        F.sum("tf").alias("sum_tf"),
        F.sum(F.length("term")).alias("sum_chars"),
        F.min("tf").alias("least_tf"),
        F.max(F.when(F.col("block") == tfidf.WORD_BLOCK, F.col("n"))).alias("longest"),
    )


@query
def tune_flat(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_documents(spark, sf).select(
        "doc_id", "text", F.col("lang").alias("label"), split_of().alias("split")
    )
    # all draws, however long they take
    trials = tune(docs, settings=replace(SETTINGS, seconds=math.inf))
    return spark.createDataFrame([tuple(t.values()) for t in trials], list(trials[0]))


# --- evaluation ------------------------------------------------------------------------------------


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(evaluate.pair_counts(scored_documents(spark, sf)))


@query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    report = evaluate.class_report(evaluate.pair_counts(scored_documents(spark, sf)))
    scores = ("precision", "recall", "f1_score", "support")
    return report.select("label", *(F.round(s, 6).alias(s) for s in scores))


@query
def f1_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = evaluate.f1_scores(evaluate.pair_counts(scored_documents(spark, sf)))
    return scores.select(*(F.round(c, 6).alias(c) for c in scores.columns))


@query
def top_confusions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.top_confusions(evaluate.pair_counts(scored_documents(spark, sf)), 3)


# --- topics ----------------------------------------------------------------------------------------


@query
def unit_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = topics.unit_embeddings(table(spark, sf, "embeddings"))
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", "pos", F.round("value", 6).alias("value")
    )


@query
def cluster_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = topics.cluster_documents(table(spark, sf, "embeddings"), k=12)
    return rows.select("vec_id", "cluster")


@query
def cluster_check(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of found clusters: all rows have one, numbers follow falling sizes."""
    rows = topics.cluster_documents(table(spark, sf, "embeddings"), k=12)
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("cluster >= 0")
    after = Window.orderBy("cluster")  # a row per cluster, k at most
    ranked = sizes.select(
        "cluster", "n", F.lag("n").over(after).alias("larger"), F.row_number().over(after).alias("place")
    )
    good = (F.col("cluster") == F.col("place") - 1) & (F.coalesce("larger", "n") >= F.col("n"))
    noise = rows.agg(F.count_if(F.col("cluster") < 0))
    return ranked.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) + noise.scalar()).alias("vectors"),
        F.coalesce(F.bool_and(good), F.lit(True)).alias("numbered_by_size"),
        F.coalesce(F.min("n") >= fv.TOPIC_MIN_SIZE, F.lit(True)).alias("large_enough"),
    )


@query
def renumber_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = clustered_embeddings(spark, sf).select("vec_id", "cluster")
    return topics.renumber_clusters(rows, min_size=45)


@query
def topic_info(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_info(clustered_embeddings(spark, sf))


@query
def select_topics(spark: SparkSession, sf: str) -> DataFrame:
    info = topics.topic_info(clustered_embeddings(spark, sf))
    return topics.select_topics(info, **TOPIC_LIMITS)


@query
def topic_coverage(spark: SparkSession, sf: str) -> DataFrame:
    info = topics.topic_info(clustered_embeddings(spark, sf))
    return topics.topic_coverage(info, **TOPIC_LIMITS)


@query
def topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = topics.topic_terms(spread_documents(spark, sf), "source")
    return rows.withColumn("weight", F.round("weight", 6))


@query
def topic_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", "source", "text")
    return topics.topic_examples(rows, "source", "doc_id")
