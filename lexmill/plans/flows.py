"""The three end-to-end flows over article tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill import fixed_values as fv
from lexmill.functions.text import clean_news, normalize_text
from lexmill.operators.classifier import Settings, TopicClassifier, TopicClassifierModel
from lexmill.operators.dedup import (
    dedup_report,
    dedup_split_table,
    drop_duplicates_normalized,
    overlap_counts,
)
from lexmill.operators.labels import label_by_split, require_labels
from lexmill.operators.select import (
    columns_with_prefix,
    combine_text,
    map_lookup,
    non_empty,
    text_label,
)
from lexmill.operators.splits import stratified_split
from lexmill.operators.topics import (
    cluster_documents,
    rows_of_topics,
    select_topics,
    topic_coverage,
    topic_info,
    topic_terms,
    unit_embeddings,
)
from lexmill.session import written


def prepare_articles(
    articles: DataFrame, title: str = "Judul", content: str = "Content", min_length: int = 1
) -> DataFrame:
    """Title, content and tags in one ``text`` column; rows without text are dropped."""
    columns = [title, content, *columns_with_prefix(articles)]
    return non_empty(combine_text(articles, columns, out_col="text"), "text", min_length)


def long_text_flow(
    articles: DataFrame,
    id_col: str,
    label_col: str = "topic",
    cleaners: tuple[str, ...] = ("clean_news",),
    params: Mapping | None = None,
    settings: Settings = Settings(),
    seed: int = 42,
) -> tuple[TopicClassifierModel, dict[str, DataFrame]]:
    """One labelled article table: de-duplicate, split 80/10/10, fit and evaluate."""
    texts = drop_duplicates_normalized(
        prepare_articles(articles), ["text"], clean_news, order_by=[id_col]
    )
    labelled = text_label(texts, "text", label_col, F.col(id_col).alias("doc_id"))
    # written, as the split reads its input several times and the fit reads the split
    labelled = written(require_labels(labelled), "labelled")
    split = written(stratified_split(labelled, seed=seed), "split")
    model = TopicClassifier(cleaners, params=params, settings=settings).fit(split)
    evaluation = model.evaluate(split.filter(F.col("split") == "test"))
    model.state.test_macro_f1 = evaluation["scores"].first()["macro_f1"]
    return model, evaluation


def short_text_flow(
    splits: DataFrame,
    id_col: str = "doc_id",
    cleaners: tuple[str, ...] = ("clean_news", "mask_finance"),
    params: Mapping | None = None,
    settings: Settings = Settings(),
) -> dict:
    """A pre-split table: label counts, leakage removal, fit and evaluation."""
    kept = written(dedup_split_table(splits, [id_col], key_fn=normalize_text), "kept")
    model = TopicClassifier(cleaners, params=params, settings=settings).fit(
        text_label(kept, "text", "label", F.col(id_col).alias("doc_id"), "split")
    )
    test = kept.filter(F.col("split") == "test")
    return {
        "label_counts": label_by_split(splits),
        "overlap_before": overlap_counts(splits, key_fn=normalize_text),
        "overlap_after": overlap_counts(kept, key_fn=normalize_text),
        "report": dedup_report(splits, key_fn=normalize_text),
        "model": model,
        "evaluation": model.evaluate(
            text_label(test, "text", "label", F.col(id_col).alias("doc_id"))
        ),
    }


def topic_flow(
    articles: DataFrame,
    k: int,
    embedding_col: str = "embedding",
    names: Mapping[int, str] | None = None,
) -> dict[str, DataFrame]:
    """Discover topics from embeddings, list what is needed to name them, and name them."""
    cleaned = articles.withColumn("Content_clean", clean_news(F.col("Content")))
    combined = combine_text(cleaned, ["Judul", "Content_clean", *columns_with_prefix(articles)])
    texts = unit_embeddings(non_empty(combined, "text_for_cluster"), embedding_col)
    texts = written(texts, "texts")
    clustered = written(cluster_documents(texts, k, embedding_col), "clustered")
    info = topic_info(clustered)
    selected = select_topics(info)
    return {
        "documents": map_lookup(clustered, "cluster", names or fv.TOPIC_NAMES, "topic"),
        "info": info,
        "selected": selected,
        "selected_documents": rows_of_topics(clustered, selected),
        "coverage": topic_coverage(info),
        "terms": topic_terms(clustered, "cluster", "text_for_cluster"),
    }
