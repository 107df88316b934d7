"""Toxicity, language, quality: odd rows, and accuracy on rows that didn't train."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import quality_cnn, toxicity
from lexmill.llm.byte_words import PUNCTUATED, words_of
from lexmill.llm.language_id import UNKNOWN, fuse_languages, markup_language, page_text, train_languages
from lexmill.llm.queries import op9_quality_cnn
from lexmill.llm.quality_cnn import bounded_sample, new_network, score_quality, train_quality
from lexmill.llm.toxicity import fit_ordinal, score_toxicity, severity_grades, train_toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = labels.sum()
    return (rank[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


# ---------------------------------------------------------------- quality


def test_gradients_are_those_of_the_loss():
    draw = np.random.Generator(np.random.PCG64(1))
    texts = [draw.integers(1, 256, n).astype(np.uint8) for n in (0, 3, 200, 900)]
    labels, net = np.array([0.0, 1.0, 1.0, 0.0]), new_network()
    _, grads = quality_cnn.gradients(net, texts, labels)
    for part in range(4):
        where = np.unravel_index(np.argmax(np.abs(grads[part])), grads[part].shape)
        losses = []
        for step in (1e-3, -1e-3):
            parts = [p.copy() for p in net]
            parts[part][where] += step
            losses.append(quality_cnn.gradients(quality_cnn.Network(*parts), texts, labels)[0])
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(float(grads[part][where]), rel=0.05, abs=1e-4)


def test_pieces_and_batches_do_not_matter():
    draw = np.random.Generator(np.random.PCG64(2))
    net = new_network()
    texts = [draw.integers(1, 256, n).astype(np.uint8) for n in (5, 0, 127, 128, 300_000, 129)]
    together = quality_cnn.score_texts(net, texts)
    alone = np.concatenate([quality_cnn.score_texts(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    # the end of a long text counts
    changed = texts[4].copy()
    changed[-200:] = 37
    assert quality_cnn.score_texts(net, [changed])[0] != alone[4]


def test_quality_on_held_out_rows(spark):
    got = op9_quality_cnn(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 60 and got.count() == 1000
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.85
    assert ((rows["score"] >= 0.7).astype(int) == rows["predicted"]).all()


def test_odd_quality_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, ""), (None, "b")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("theirs")).withColumn("label", F.lit(9))
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, label int")
    assert bounded_sample(docs, none, 10).count() == 0
    assert train_quality(docs, none) is None
    assert {r.score for r in score_quality(docs, None).collect()} == {0.5}
    scored = score_quality(docs, new_network())
    assert scored.columns == ["doc_id", "text", "label", "score"]
    rows = scored.collect()
    assert len(rows) == 4 and len({r.score for r in rows if not r.text}) == 1
    assert score_quality(docs.limit(0), new_network()).count() == 0


# ---------------------------------------------------------------- toxicity


def test_ordinal_regression_finds_the_grades():
    draw = np.random.Generator(np.random.PCG64(4))
    x = draw.normal(size=(800, 6))
    margin = x @ np.array([2.0, -1.5, 0, 0, 0, 0])
    grades = np.digitize(margin + draw.logistic(size=800) * 0.3, [-1.0, 0.5, 2.0])
    rows = toxicity._Rows(np.arange(0, 4801, 6), np.tile(np.arange(6), 800), x.ravel())
    w, t = fit_ordinal(rows, grades, 6, penalty=5e-3, steps=500)
    assert np.all(np.diff(t) > 0) and w[0] > 0 > w[1] and np.abs(w[2:]).max() < 0.2 * w[0]
    above = toxicity._sigmoid((x @ w)[:, None] - t).sum(1)
    assert np.corrcoef(above, grades)[0, 1] > 0.9


def test_loss_derivatives():
    draw = np.random.Generator(np.random.PCG64(5))
    margin, grade, t = draw.normal(size=40), draw.integers(0, 4, 40), np.array([-0.5, 0.3, 1.2])

    def loss(m, cuts):
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        cum = 1 / (1 + np.exp(-(edges[None, :] - m[:, None])))
        return -np.log(cum[np.arange(40), grade + 1] - cum[np.arange(40), grade]).mean()

    by_margin, by_threshold = toxicity._loss_parts(margin, grade, t)
    for k in (0, 7):
        e = np.eye(40)[k] * 1e-5
        assert (loss(margin + e, t) - loss(margin - e, t)) / 2e-5 == pytest.approx(by_margin[k], abs=1e-6)
    for k in range(3):
        e = np.eye(3)[k] * 1e-5
        assert (loss(margin, t + e) - loss(margin, t - e)) / 2e-5 == pytest.approx(by_threshold[k], abs=1e-6)


def test_toxic_documents(spark):
    draw = random.Random(6)
    plain, bad = [f"w{i}" for i in range(200)], ["vile", "awful", "nasty"]
    rows = []
    for i in range(1200):
        words = draw.choices(plain, k=40)
        n = draw.choice([0] * 9 + [2, 4, 8])
        words[:n] = draw.choices(bad, k=n)
        draw.shuffle(words)
        rows.append((i, " ".join(words), n))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs = docs.withColumn("toxic", F.lit("theirs")).withColumn("extra", F.lit(1))
    labels = spark.createDataFrame([(i, int(n > 0)) for i, _, n in rows if i % 2], "doc_id long, label int")
    model = train_toxicity(docs, labels, binary=True)
    assert len(model.thresholds) >= 2 and np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    fresh = [r for r in rows if r[0] % 2 == 0]
    assert np.mean([got[i].toxic == (n > 0) for i, _, n in fresh]) > 0.97
    severity = {n: np.mean([got[i].severity for i, _, m in fresh if m == n]) for n in (0, 2, 4, 8)}
    assert severity[0] < severity[2] < severity[4] < severity[8]
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "VILE! nasty, awful vile")], docs.select("doc_id", "text").schema)
    flags = [r.toxic for r in score_toxicity(odd, model).orderBy(F.col("text").asc_nulls_first()).collect()]
    assert flags == [False, False, True]
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_toxic_rows_that_did_not_train(spark):
    """Labels of every other document train; the others are caught, clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs, known.filter("doc_id % 2 = 0"), binary=True)
    assert 0 < model.cut <= 0.5
    held = docs.join(known.filter("doc_id % 2 = 1"), "doc_id")
    rows = score_toxicity(held, model).toPandas()
    caught = rows["grade"][rows["label"] == 1] > 0
    alarms = rows["grade"][rows["label"] == 0] > 0
    assert len(caught) > 150 and caught.mean() > 0.88 and alarms.mean() < 0.01
    assert (rows["toxic"] == (rows["grade"] > 0)).all()
    # severity by plain Python
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    for r in held.join(known.select("doc_id"), "doc_id").limit(40).collect():
        found = {}
        for words in words_of(pa.array([r.text]), PUNCTUATED):
            for hashes, own in toxicity._features(words):
                for h in hashes[own].tolist():
                    found[h] = found.get(h, 0) + 1
        margin = sum(weights.get(h, 0) * math.log1p(n) for h, n in found.items())
        severity = sum(1 / (1 + math.exp(t - margin)) for t in model.thresholds)
        assert rows.set_index("doc_id").loc[r.doc_id, "severity"] == pytest.approx(severity)


def test_beginnings_of_words():
    """Equal beginnings are one feature, in any case, and only of longer words."""
    words = next(words_of(pa.array(["Bomente bomentes x bomentell"]), PUNCTUATED))
    kinds = toxicity._features(words)
    longer = [own.tolist() for _, own in kinds[1:]]
    assert longer == [[True, True, False, True]] * 3 + [[False, True, False, True]] + [[False] * 3 + [True]]
    six = kinds[3][0]
    assert six[0] == six[1] == six[3] != six[2]
    assert len({int(h[1]) for h, _ in kinds}) == len(kinds)


def test_toxicity_without_grades(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = score_toxicity(docs, train_toxicity(docs, none)).collect()
    assert [(r.severity, r.grade, r.toxic) for r in rows] == [(0.0, 0, False)] * 2
    ones = spark.createDataFrame([(1, 0), (2, 0)], none.schema)
    assert [r.grade for r in score_toxicity(docs, train_toxicity(docs, ones)).collect()] == [0, 0]


def test_derived_grades():
    words = [np.array([k], np.uint64) for k in [1] * 30 + [2] * 30]
    toxic = np.array([0] * 30 + [1] * 30)
    counts = [np.array([c], np.uint32) for c in [1] * 30 + [1] * 10 + [5] * 10 + [9] * 10]
    grades = severity_grades(counts, words, toxic)
    assert set(grades[:30]) == {0} and list(grades[30::10]) == [1, 2, 3]


# ---------------------------------------------------------------- languages


@pytest.fixture(scope="module")
def languages(spark):
    return train_languages(spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang"))


def test_document_languages(spark, languages):
    assert languages[0] == ["de", "en", "es", "fr"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blind = F.lit(None).cast("string")
    rows = fuse_languages(docs, languages, F.col("text"), blind, F.col("source"), F.lit("")).toPandas()
    assert len(rows) == 1000 and (rows["lang"] == rows["language"]).mean() > 0.98
    assert not rows["rejected"].any()


def test_evidence_is_weighed(spark, languages):
    german = "und die der das nicht ist mit den von zu ein eine auf für werden " * 3
    rows = [
        (1, german, "de", "h1", "de"), (2, german, "en", "h1", "de"), (3, "", "fr", "h9", "xx"),
        (4, None, None, "h1", "de"), (5, None, None, "h9", "xx"), (6, "@@@ 123", "zz", None, None),
        (7, "qxz kqj zzx xqk jjq qqz " * 10, "en", "h8", "yy"), (2, german, "en", "h1", "de"),
    ]
    rows += [(100 + i, german, "de", "h1", "de") for i in range(40)]
    rows += [(200 + i, "the and of to in that is was for it with as " * 3, "en", "h2", "com") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, mark string, host string, end string")
    df = df.withColumn("language", F.lit("old")).withColumn("n", F.lit(3)).withColumn("key", F.lit(1))
    got = fuse_languages(df, languages, F.col("text"), F.col("mark"), F.col("host"), F.col("end"))
    assert got.columns == ["id", "text", "mark", "host", "end", "n", "key", "language", "posterior", "rejected"]
    by = {r.id: r for r in got.collect()}
    assert got.count() == len(rows)
    # the text outweighs a wrong declaration; without text declaration, then host decide
    assert [by[k].language for k in (1, 2, 3, 4)] == ["de", "de", "fr", "de"]
    assert by[7].language == UNKNOWN and by[7].rejected
    assert by[5].posterior < by[4].posterior
    assert all(0 < r.posterior <= 1 for r in by.values())
    assert fuse_languages(df.limit(0), languages, F.col("text"), F.col("mark"), F.col("host"), F.col("end")).count() == 0


def test_no_language_known(spark):
    texts = spark.createDataFrame([("a", None), (None, UNKNOWN)], "text string, lang string")
    model = train_languages(texts)
    row = fuse_languages(texts, model, F.col("text"), F.col("lang"), F.lit("h"), F.lit("s")).first()
    assert (row.language, row.rejected) == (UNKNOWN, True)


def test_markup(spark):
    html = "<HTML class=x LANG = 'de-AT'><style>p{}</style><p>Ja<script>var a='<b>';</script> nein<!-- x -->"
    row = spark.range(1).select(markup_language(F.lit(html)).alias("m"), page_text(F.lit(html)).alias("t")).first()
    assert row.m == "de" and row.t.split() == ["Ja", "nein"]


def test_arrow_offsets():
    model = toxicity.Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    assert list(toxicity.margins(model, pa.array(["a", "b", None])[1:])) == [0, 0]
