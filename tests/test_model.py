"""TF-IDF, hierarchy, classifier and bundle."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.ngrams import char_ngrams, word_ngrams
from lexmill.operators import classifier as cl
from lexmill.operators import hierarchy, labels, svm, tfidf
from lexmill.session import written
from lexmill.sources.bundle import load_bundle, read_meta, save_bundle

CFG = tfidf.TfidfConfig(ngram_max=2, min_df=1, max_df=0.9)
TEXTS = ["the cat sat on the mat", "The dog é sat", "", "a cat, a dog; the CAT", "zz"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_char_ngrams(spark):
    df = spark.createDataFrame([(0, "a"), (1, "ab"), (2, "abcd"), (3, " ")], "d int, text string")
    got = {}
    for r in char_ngrams(df, "text", ["d"]).collect():
        got.setdefault(r["d"], []).append(r["term"])
    assert sorted(got[0]) == [" a "]
    assert sorted(got[1]) == sorted([" ab", "ab ", " ab "])
    assert sorted(got[2]) == sorted(
        [" ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "]
    )
    assert 3 not in got


def test_word_ngrams(docs):
    got = Counter(r["term"] for r in word_ngrams(docs, "text", ["doc_id"], 2).collect())
    assert got["the cat"] == 2  # from documents 0 and 3
    assert "a" not in got and got["zz"] == 1


def test_weights_against_plain_python(docs):
    vocab = tfidf.fit_vocabulary(docs, CFG)
    rows = tfidf.tfidf_transform(docs, vocab, CFG).filter("block = 'word'").collect()
    counts = []
    for text in TEXTS:
        words = re.findall(r"\w{2,}", text.lower())
        pairs = [" ".join(p) for p in zip(words, words[1:], strict=False)]
        counts.append(Counter(words + pairs))
    n = len(TEXTS)
    df = Counter(t for c in counts for t in c)
    kept = {t for t, k in df.items() if k <= CFG.max_df * n}
    expected = {}
    for i, c in enumerate(counts):
        raw = {
            t: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[t])) + 1)
            for t, k in c.items() if t in kept
        }
        length = math.sqrt(sum(w * w for w in raw.values()))
        expected |= {(i, t): w / length for t, w in raw.items()}
    got = {(r["doc_id"], r["term"]): r["weight"] for r in rows}
    assert got == pytest.approx(expected)


def test_packed_equals_rows_and_keeps_empty_documents(docs):
    vocab = tfidf.fit_vocabulary(docs, CFG)
    packed = {
        r["doc_id"]: dict(zip(r["indices"], r["values"], strict=True))
        for r in tfidf.packed_documents(docs, vocab, CFG).collect()
    }
    rows = {}
    for r in tfidf.tfidf_transform(docs, vocab, CFG).collect():
        rows.setdefault(r["doc_id"], {})[r["idx"]] = r["weight"]
    assert packed[2] == {}
    for doc, entries in packed.items():
        assert list(entries) == sorted(entries)
        assert entries == pytest.approx(rows.get(doc, {}))
        assert sum(w * w for w in entries.values()) == pytest.approx(2 if entries else 0, abs=1)


def test_texts_are_not_shuffled(spark, tmp_path, docs):
    """A table with enough splits is counted and weighed where it is read."""
    path = str(tmp_path / "docs")
    docs.withColumn("label", F.lit("a")).repartition(8).write.parquet(path)
    table = spark.read.parquet(path).repartition(8, "doc_id")
    table.write.mode("append").parquet(path + "2")
    table = spark.read.option("maxPartitionNum", 64).parquet(path + "2")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a split per file
    try:
        vocab = tfidf.fit_vocabulary(table, CFG)
        frames = [
            tfidf.packed_documents(table, vocab, CFG),
            tfidf.tfidf_transform(table, vocab, CFG),
            tfidf.term_counts(table),
        ]
        for frame in frames:
            plan = frame._jdf.queryExecution().optimizedPlan().toString()
            assert "Repartition" not in plan and "Aggregate" not in plan
        stats = tfidf.term_stats(table, least=(2, 2))._jdf.queryExecution().optimizedPlan()
        assert stats.toString().count("Repartition") == 0
        assert stats.toString().index("Aggregate") < stats.toString().index("MapInArrow")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


ODD = [
    "", " ", None, "é ÀÉÎ\u00a0x_1 日本語 \U0001f600😀 a", "aa aa aa bb", "Straße İstanbul ΣΑΣ",
    "x" * 3000 + " tail", "a b c d e f g", "tab\tand\nline",
]


def test_counts_against_expanded_grams(spark):
    """Counts inside the task equal those of the n-grams as rows."""
    df = spark.createDataFrame(list(enumerate(ODD + TEXTS)), "doc_id int, text string")
    got = {
        (r["doc_id"], r["block"], r["n"], r["term"]): r["tf"]
        for r in tfidf.term_counts(df, 3).collect()
    }
    grams = [
        (block, rows)
        for block, rows in (
            ("word", word_ngrams(df, "text", ["doc_id"], 3)),
            ("char", char_ngrams(df, "text", ["doc_id"])),
        )
    ]
    expected = Counter(
        (r["doc_id"], block, r["n"], r["term"]) for block, rows in grams for r in rows.collect()
    )
    assert got == expected
    by_term = Counter()
    docs = Counter()
    for (_, block, n, term), tf in expected.items():
        by_term[block, n, term] += tf
        docs[block, n, term] += 1
    for least in ((1, 1), (1, 2), (2, 2), (3, 2)):
        stats = {
            (r["block"], r["n"], r["term"]): (r["df"], r["tf"])
            for r in tfidf.term_stats(df, 3, least=least).collect()
        }
        low = dict(zip(tfidf.BLOCKS, least, strict=True))
        assert stats == {
            k: (docs[k], by_term[k]) for k in by_term if docs[k] >= low[k[0]]
        }


def test_crowded_filter_keeps_all(spark, docs, monkeypatch):
    """With one cell for all terms nothing is dropped early, and the counts are the same."""
    whole = sorted(map(tuple, tfidf.term_stats(docs, 2, least=(2, 2)).collect()))
    bits = np.full(tfidf.FILTER_BITS // 8, 255, np.uint8)
    monkeypatch.setattr(tfidf, "seen_again", lambda *_: bits)
    assert sorted(map(tuple, tfidf.term_stats(docs, 2, least=(2, 2)).collect())) == whole


def test_large_vocabularies_are_joined(docs, monkeypatch):
    vocab = tfidf.fit_vocabulary(docs, CFG)
    rows = lambda: {
        r["doc_id"]: (r["indices"], pytest.approx(r["values"]))
        for r in tfidf.packed_documents(docs, vocab, CFG).collect()
    }
    sent = {k: (i, v.expected) for k, (i, v) in rows().items()}
    monkeypatch.setattr(tfidf, "MAPPED_TERMS", 1)
    assert rows() == sent


def test_limits_that_exclude_each_other(docs):
    with pytest.raises(ValueError, match="max_df"):
        tfidf.fit_vocabulary(docs, tfidf.TfidfConfig(min_df=5, max_df=0.5))


def _brute_linkage(dist, k):
    groups = [[i] for i in range(len(dist))]
    while len(groups) > k:
        pairs = [
            (np.mean([dist[x][y] for x in a for y in b]), i, j)
            for i, a in enumerate(groups)
            for j, b in enumerate(groups)
            if i < j
        ]
        _, i, j = min(pairs)
        groups[i] = groups[i] + groups.pop(j)
    return {frozenset(g) for g in groups}


def _distances(spark, dist):
    names = [f"l{i:03d}" for i in range(len(dist))]
    rows = [(a, b, float(dist[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "label_a string, label_b string, dist double")


def _groups(rows):
    found = {}
    for r in rows:
        found.setdefault(r["cluster"], set()).add(int(r["label"][1:]))
    # numbered by their first member
    firsts = [min(found[c]) for c in range(len(found))]
    assert firsts == sorted(firsts)
    return {frozenset(g) for g in found.values()}


def test_merging_against_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.random((14, 3))
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    merges = hierarchy._merge_in_memory(dist, np.ones(14), np.arange(14))
    for k in (1, 3, 6, 14):
        numbers = hierarchy._cut(merges, 14, k)
        got = {frozenset(np.flatnonzero(np.array(numbers) == c)) for c in set(numbers)}
        assert got == _brute_linkage(dist, k)
    table = _distances(spark, dist)
    for k in (4,):
        joined = _groups(hierarchy.agglomerate(table, k, most=1).collect())
        assert joined == _brute_linkage(dist, k)
    assert hierarchy.agglomerate(table.limit(0)).count() == 0
    assert hierarchy.agglomerate(_distances(spark, dist[:1, :1])).collect() == [("l000", 0)]


def test_equal_distances_merge_the_same_way(spark):
    """Unrelated labels, all at distance 1, in memory and by joins."""
    dist = np.ones((7, 7)) - np.eye(7)
    dist[2, 5] = dist[5, 2] = 0.25
    table = _distances(spark, dist)
    whole = _groups(hierarchy.agglomerate(table, 3).collect())
    assert whole == _groups(hierarchy.agglomerate(table, 3, most=3).collect())
    assert any({2, 5} <= g for g in whole)


def test_distances_by_tiles(spark):
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((11, 40)) < 0.4, rng.random((11, 40)), 0)
    dense[6] = 0  # a label without terms
    cells = [(f"l{a:02d}", int(i), float(w)) for a, row in enumerate(dense) for i, w in enumerate(row) if w]
    centroids = spark.createDataFrame(cells, "label string, idx int, weight double")
    names = spark.createDataFrame([(f"l{a:02d}",) for a in range(11)], "label string")
    length = np.linalg.norm(dense, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        expected = 1 - dense @ dense.T / np.outer(length, length)
    expected = np.where(np.isfinite(expected), expected, 1.0)
    np.fill_diagonal(expected, 0)
    for tile, terms in ((256, 1 << 14), (4, 7)):
        rows = hierarchy.centroid_distance(centroids, names, tile=tile, terms=terms).collect()
        assert len(rows) == 121
        got = {(int(r["label_a"][1:]), int(r["label_b"][1:])): r["dist"] for r in rows}
        assert all(got[a, b] == pytest.approx(expected[a, b]) for a in range(11) for b in range(11))


def test_rare_labels(spark):
    support = spark.createDataFrame(
        [("k1", 50, True), ("k2", 50, True), ("p", 1, False), ("q", 2, False)],
        "label string, n bigint, kept boolean",
    )
    clusters = spark.createDataFrame([("k1", 0), ("k2", 2)], "label string, cluster int")
    got = {r["label"]: r["aggregate"] for r in hierarchy.rare_buckets(support, clusters).collect()}
    assert got == {"k1": "C0", "k2": "C2", "p": "C3", "q": "C4"}
    none = clusters.limit(0)
    rare = support.filter("not kept")
    got = {r["label"]: r["aggregate"] for r in hierarchy.rare_buckets(rare, none).collect()}
    assert got == {"p": "C0", "q": "C1"}
    df = spark.createDataFrame([("k1",), ("new",)], "label string")
    mapping = spark.createDataFrame([("k1", "C0")], "label string, aggregate string")
    out = hierarchy.apply_aggregate(df, mapping).collect()
    assert {(r["label"], r["aggregate"]) for r in out} == {("k1", "C0"), ("new", "C999")}


def test_fallback_ties_go_to_the_smaller_label(spark):
    rows = [("C0", "b")] * 5 + [("C0", "a")] * 5 + [("C1", "x")] * 3 + [("C2", "u"), ("C2", "v")] * 50
    df = spark.createDataFrame(rows, "aggregate string, label string")
    got = {r["aggregate"]: r["fallback"] for r in svm.stage2_fallbacks(df).collect()}
    assert got == {"C0": "a", "C1": "x"}


def test_routing_without_any_answer_fails(spark):
    stage1 = spark.createDataFrame([(1, "C7", 1.0)], "doc_id int, class string, score double")
    stage2 = spark.createDataFrame(
        [(1, "C0", "a", 1.0)], "doc_id int, aggregate string, class string, score double"
    )
    none = spark.createDataFrame([], "aggregate string, fallback string")
    with pytest.raises(Exception, match="no classifier and no fallback for C7"):
        svm.route_predict(stage1, stage2, none, ["doc_id"]).collect()


def _weather_and_trains(spark):
    words = {
        "rain": "rain cloud storm wind", "sun": "sun heat dry cloud",
        "train": "train rail station ticket", "bus": "bus road station ticket",
        "odd": "unseen oddity",
    }
    rows = []
    for label, text in words.items():
        pool = text.split()
        for i in range(3 if label == "odd" else 30):
            split = ("test", "validation")[i % 10] if i % 10 < 2 else "train"
            body = " ".join(pool[(i + j) % len(pool)] for j in range(3)) + f" {label} n{i % 4}"
            rows.append((len(rows), body, label, split))
    rows.append((len(rows), "late label", "late", "validation"))
    return spark.createDataFrame(rows, "doc_id int, text string, label string, split string")


PARAMS = {"ngram_max": 1, "min_df": 1, "max_df": 0.95, "word_max_features": 500,
          "char_max_features": 500, "C": 1.0}
SETTINGS = cl.Settings(trials=2, min_bucket_size=20, n_clusters=2)


@pytest.fixture(scope="module")
def fitted(spark):
    df = _weather_and_trains(spark)
    return df, cl.TopicClassifier(("clean_news",), params=PARAMS, settings=SETTINGS).fit(df)


def test_hierarchy_and_scores(fitted):
    df, model = fitted
    mapping = {r["label"]: r["aggregate"] for r in model.state.tables["aggregate_map"].collect()}
    assert mapping["rain"] == mapping["sun"] != mapping["train"] == mapping["bus"]
    assert "late" not in mapping
    assert mapping["odd"] == "C2"
    fallbacks = {r["aggregate"]: r["fallback"] for r in model.state.tables["fallbacks"].collect()}
    assert fallbacks == {"C2": "odd", "C999": "late"}
    test = df.filter("split = 'test'")
    scores = model.evaluate(test)["scores"].first()
    majority = max(r["count"] for r in test.groupBy("label").count().collect()) / test.count()
    assert scores["micro_f1"] > 0.9 > majority


def test_blocks_of_classes_agree(fitted):
    df, model = fitted
    tables, cfg = model.state.tables, model.state.tfidf
    docs = df.select("doc_id", "text").unionByName(
        df.sparkSession.createDataFrame([(-1, ""), (-2, "zzz")], "doc_id int, text string")
    )
    packed = written(tfidf.packed_documents(docs, tables["vocabulary"], cfg), "packed")
    size = tables["vocabulary"].count()
    stage = tables["coefficients"].filter("stage = 'stage1'")
    whole, single, plain = (
        {r["doc_id"]: r["pred"] for r in rows.collect()}
        for rows in (
            svm.best_of_stage(packed, stage, size, ["doc_id"]),
            svm.best_of_stage(packed, stage, size, ["doc_id"], cells=1),
            svm.score_argmax(
                packed.select("doc_id", F.explode(F.arrays_zip("indices", "values")).alias("z")).select(
                    "doc_id", F.col("z.indices").alias("idx"), F.col("z.values").alias("weight")
                ),
                packed.select("doc_id"), stage, ["doc_id"],
            ),
        )
    )
    assert whole == single == plain and len(whole) == docs.count()


def test_repeated_ids_keep_their_rows(fitted):
    df, model = fitted
    same = df.withColumn("doc_id", F.lit(1)).withColumn("extra", F.create_map(F.lit("a"), "label"))
    by_text = {r["text"]: r["pred"] for r in model.transform(df).collect()}
    out = model.transform(same).collect()
    assert len(out) == df.count()
    assert all(r["pred"] == by_text[r["text"]] and r["extra"] == {"a": r["label"]} for r in out)


def test_unknown_splits_do_not_vanish(spark):
    df = _weather_and_trains(spark).withColumn(
        "split", F.when(F.col("doc_id") % 9 == 0, "val").otherwise(F.col("split"))
    )
    with pytest.raises(ValueError, match="'val': "):
        cl.TopicClassifier(params=PARAMS, settings=SETTINGS).fit(df)


def test_transform_keeps_columns(fitted):
    df, model = fitted
    out = model.transform(df)
    assert set(out.columns) == {*df.columns, "aggregate", "pred"}
    assert out.count() == df.count()


def test_bundle(spark, fitted, tmp_path):
    df, model = fitted
    folder = save_bundle(
        model, str(tmp_path / "b"), ["text"], "label", dataset="d", test_macro_f1=0.5, extra_meta={"notes": "n", "cleaning": {"x": 1}}
    )
    meta = read_meta(spark, folder)
    assert (meta["dataset"], meta["notes"], meta["cleaning"]) == ("d", "n", {"x": 1})
    assert meta["params"] == PARAMS
    assert meta["metrics"]["test_macro_f1"] == 0.5
    again = load_bundle(spark, folder)
    assert again.state.settings == SETTINGS
    before, after = (sorted(map(tuple, m.predict(df).collect())) for m in (model, again))
    assert before == after
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, str(tmp_path / "nothing"))
    # a model that reads from the bundle can be saved to it again
    save_bundle(again, folder, ["text"], "label", dataset="second")
    assert read_meta(spark, folder)["dataset"] == "second"


def test_stopped_save_leaves_the_old_model(spark, fitted, tmp_path, monkeypatch):
    df, model = fitted
    folder = save_bundle(model, str(tmp_path / "b"), ["text"], "label", dataset="old")
    writes = []

    def stop(self, path, *args, **kwargs):
        writes.append(path)
        if len(writes) == 4:
            raise OSError("the driver is gone")
        return whole(self, path, *args, **kwargs)

    from pyspark.sql import DataFrameWriter

    whole = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", stop)
    with pytest.raises(OSError, match="gone"):
        save_bundle(model, folder, ["text"], "label", dataset="new")
    monkeypatch.undo()
    assert read_meta(spark, folder)["dataset"] == "old"
    assert load_bundle(spark, folder).state.params == PARAMS
    save_bundle(model, folder, ["text"], "label", dataset="newer")
    assert read_meta(spark, folder)["dataset"] == "newer"


def test_torn_versions_do_not_load(spark, fitted, tmp_path):
    _, model = fitted
    folder = save_bundle(model, str(tmp_path / "b"), ["text"], "label")
    (version,) = (tmp_path / "b" / "versions").iterdir()
    part = next((version / "labels").glob("*.parquet"))
    kept = part.read_bytes()
    part.with_name(f".{part.name}.crc").unlink()
    part.write_bytes(kept[:-1] + bytes([kept[-1] ^ 1]))
    with pytest.raises(ValueError, match="labels"):
        load_bundle(spark, folder)
    part.write_bytes(kept)
    assert load_bundle(spark, folder).state.params == PARAMS
    part.rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="labels"):
        load_bundle(spark, folder)


def test_unfitted_model():
    with pytest.raises(RuntimeError, match="has no state"):
        cl.TopicClassifierModel().get_state()
    with pytest.raises(RuntimeError, match="fit or load"):
        cl.TopicClassifierModel().predict(None)


def test_search(spark):
    df = _weather_and_trains(spark).filter("label not in ('odd', 'late')")
    space = {"word_max_features": (100, 300, 100), "char_max_features": (100, 300, 100)}
    trials = cl.tune(df, settings=SETTINGS, space=space)
    assert len(trials) == 2
    assert trials[0]["macro_f1"] >= trials[1]["macro_f1"] > 0.5
    assert 0.85 <= trials[0]["max_df"] <= 0.99
    assert all(0.2 <= t["C"] <= 5 for t in trials)


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    got = {r["label"]: r["weight"] for r in svm.balanced_weights(df).collect()}
    assert got == pytest.approx({"a": 4 / 6, "b": 2.0})


def test_single_label(spark):
    df = spark.createDataFrame(
        [(i, f"text number{i % 3}", "only", "train") for i in range(12)],
        "doc_id int, text string, label string, split string",
    )
    model = cl.TopicClassifier(params=PARAMS, settings=SETTINGS).fit(df)
    assert {(r["aggregate"], r["pred"]) for r in model.predict(df).collect()} == {("C0", "only")}
    assert labels.label_support(df).first()["kept"]


def test_flow_prepares_articles(spark):
    from lexmill.plans.flows import prepare_articles

    df = spark.createDataFrame([("T", "C", "x"), (None, " ", None)],
                               "Judul string, Content string, tag1 string")
    assert [r["text"] for r in prepare_articles(df).collect()] == ["T C x"]
    assert prepare_articles(df, min_length=6).filter(F.lit(True)).count() == 0
