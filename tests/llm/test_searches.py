"""License scan, decontamination and embedding near duplicates."""

import re

import numpy as np
import pytest

from lexmill.llm import license_scan
from lexmill.llm.decontamination import find_leaks, without_leaks
from lexmill.llm.embedding_neardup import (
    _counted,
    _projected,
    _sides,
    audit_recall,
    embedding_classes,
    projections,
)
from lexmill.llm.license_scan import STEP_SHARE, TEMPLATES, band_recall, scan_licenses


# ---------------------------------------------------------------- licenses


def test_bands_find_windows():
    assert band_recall(1 - 2 / STEP_SHARE) > 0.999


def test_licenses_anywhere(spark):
    filler = [f"word{i}" for i in range(300)]
    rows, expected = [], set()
    for number, (name, texts) in enumerate(sorted(TEMPLATES.items())):
        for part, text in enumerate(texts):
            for at in range(0, 60, 7):
                doc = 10_000 * number + 100 * part + at
                rows.append((doc, " ".join([*filler[:at], text.upper() + ".", *filler[at:]])))
                expected.add((doc, name))
    rows += [(-1, None), (-2, ""), (-3, "MIT"), (-4, "license " * 500), (-5, " ".join(filler)),
             (None, "Released under the MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license")
    got = scan_licenses(df).collect()
    assert {(r.doc_id, r.license) for r in got} >= expected | {(None, "MIT")}
    assert not {r.doc_id for r in got} & {-1, -2, -3, -4, -5}
    assert all(r.containment >= 0.8 for r in got)
    exact = {r.doc_id: r for r in got if r.license == "CC-BY-NC-4.0"}
    assert all(r.containment == 1.0 for r in exact.values())
    assert scan_licenses(df.limit(0)).count() == 0
    assert scan_licenses(df, {}).count() == 0
    with pytest.raises(ValueError, match="fewer than"):
        scan_licenses(df, {"X": ("two words",)})


def test_changed_words_count(spark):
    mit = TEMPLATES["MIT"][1].split()
    some, many = list(mit), list(mit)
    some[20] = "x"
    many[3::4] = ["x"] * len(many[3::4])
    df = spark.createDataFrame([(1, " ".join(some)), (2, " ".join(many))], "doc_id long, text string")
    got = scan_licenses(df).collect()
    assert [r.doc_id for r in got] == [1] and 0.8 <= got[0].containment < 1


def test_similar_licenses_are_told_apart(spark):
    texts = {
        "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "CC-BY-SA-4.0": TEMPLATES["CC-BY-SA-4.0"][-1],
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
        "LGPL-3.0": TEMPLATES["GPL-3.0"][1].replace("GNU", "GNU Lesser"),
        "none": TEMPLATES["MPL-2.0"][0].replace("v. 2.0", "v. 1.1"),
    }
    rows = [(i, f"some text before. {t}. And some after it.") for i, t in enumerate(texts.values())]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = list(texts)
    assert sorted((names[r.doc_id], r.license) for r in got) == [(n, n) for n in sorted(texts) if n != "none"]


def _notice(clauses):
    numbered = (f"{i}. {text}" for i, text in enumerate(clauses[1:], 1))
    return f"Copyright (c) 2020, X Y. {clauses[0]}: " + ". ".join(numbered) + ". THIS SOFTWARE IS PROVIDED"


def test_clauses_and_versions(spark):
    head, source, binary, advertising, names = license_scan._CLAUSES.values()
    texts = {
        "BSD-2-Clause": _notice([head, source, binary]),
        "BSD-3-Clause": _notice([head, source, binary, names.replace("the copyright holder", "Acme Inc")]),
        "BSD-4-Clause": _notice([head, source, binary, advertising, names]),
        "LGPL-3.0": TEMPLATES["GPL-3.0"][1].replace("GNU", "GNU Lesser").replace("program", "library"),
        "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
        "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "GPL-3.0": "all files are GPL v3.0 only unless they say so",
        "GPL-2.0": "// SPDX-License-Identifier: GPL-2.0-or-later",
        "AGPL-3.0": "# SPDX-License-Identifier: AGPL-3.0-only",
        "MIT": "/* SPDX-License-Identifier: MIT */",
        "ISC": TEMPLATES["ISC"][0],
    }
    names_ = list(texts)
    rows = [(i, f"some text before. {t}. And some after it.") for i, t in enumerate(texts.values())]
    rows.append((99, f"{head}. and nothing more is said here"))
    # two clauses in one place and three in another
    rows.append((100, texts["BSD-2-Clause"] + " word" * 300 + " " + texts["BSD-3-Clause"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in scan_licenses(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got.pop(100) == {"BSD-2-Clause", "BSD-3-Clause"}
    assert got == {i: {n} for i, n in enumerate(names_)}


def test_long_texts_repeats_and_ties(spark):
    notice = TEMPLATES["MIT"][1]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, f"{long} {notice} {long}"), (2, f"{notice} {notice}"), (2, notice), (2, notice)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.containment, r.first_word) for r in got) == sorted(
        [(1, "MIT", 1.0, 60_000), (2, "MIT", 1.0, 0), (2, "MIT", 1.0, 0), (2, "MIT", 1.0, 0)]
    )


def test_containment_against_brute_force(spark):
    """Every document and template by whole sets of shingles, in spoiled notices."""
    rng = np.random.default_rng(8)
    templates = {n: TEMPLATES[n] for n in ("MIT", "ISC", "MPL-2.0", "Apache-2.0")}
    shingled = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    words_in = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    rows, expected = [], {}
    for name, texts in templates.items():
        for text in texts:
            own = words_in(text)
            for share in (0, 0.01, 0.03, 0.06, 0.3):
                words = [w if rng.random() >= share or w.isdigit() else "zz" for w in own]
                doc = len(rows)
                rows.append((doc, " ".join(["before it"] * 9 + words + ["after it"] * 9)))
                for other, theirs in templates.items():
                    best = 0
                    for t in theirs:
                        w = words_in(t)
                        kept = shingled(w) & shingled(words_in(rows[-1][1]))
                        if all(s in kept for s in shingled(w) if any(c.isdigit() for x in s for c in x)):
                            best = max(best, len(kept) / len(shingled(w)))
                    if best >= 0.8:
                        expected[doc, other] = best
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {(r.doc_id, r.license): r.containment for r in got} == pytest.approx(expected)
    assert 30 < len(expected) < len(rows)


# ---------------------------------------------------------------- decontamination

ITEMS = [
    (1, "A train leaves Paris at 5 pm with 120 riders and reaches Lyon after 3 hours with 120 riders on board."),
    (2, "how many red marbles are in the old wooden box today"),
    (3, "too short"),
    (4, None),
    (5, "seven words make one window of them"),
    (None, "an item without any number of its own is reported too"),
]


def leaks(spark, texts, **kw):
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "0 AS place", "'s' AS slots")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "9 AS key")
    return find_leaks(docs, items, **kw)


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_leaks(spark, most):
    pad = "some plain words of no meaning here . "
    other = ITEMS[0][1].replace("120", "77").replace("Paris", "Rome").replace("Lyon", "Milan").replace("5", "8")
    wrong = ITEMS[0][1].replace("120 riders on", "121 riders on").replace("120", "77", 1)
    texts = [
        (1, pad + ITEMS[0][1] + pad), (2, pad + other), (3, pad + wrong),
        (4, ITEMS[1][1].upper() + "!"), (5, pad * 30), (6, None), (7, ""), (8, pad + ITEMS[4][1]),
        (9, "how many red marbles are"), (None, ITEMS[5][1]), (11, (ITEMS[1][1] + " ") * 400), (1, pad),
    ]
    got = leaks(spark, texts, most_keys=most)
    pairs = sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str)
    assert pairs == sorted([(1, 1), (2, 1), (4, 2), (8, 5), (None, None), (11, 2)], key=str)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted({r.doc_id for r in without_leaks(docs, got).collect()}) == [3, 5, 6, 7, 9]


def test_leaks_with_words_put_in(spark):
    long = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    words = long.split()
    ask = "a slow train to Paris needs about 5 hours for the way back home"
    items = spark.createDataFrame([(1, long), (2, ask)], "item_id long, text string")
    texts = [
        (1, " ".join([*words[:20], "really", *words[20:]])), (2, " ".join(words[:19] + words[20:])),
        (3, ask.replace("Paris", "New York")), (4, ask.replace("5 hours", "5")),
        (5, " ".join([*words[:10], *["x"] * 300, *words[30:]])),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.windows for r in find_leaks(docs, items).collect()}
    # a number without its unit is another kind of number
    assert got == {(1, 1): 26, (2, 1): 25, (3, 2): 6}


def test_units_are_told_apart(spark):
    ask = "The crew walked about {} of open track before noon"
    items = spark.createDataFrame([(1, ask.format("5 km"))], "item_id long, text string")
    same = ["5 km", "12 miles", "five km", "one metre", "3.5 m"]
    other = ["8 kg", "5 hours", "12%", "$5", "€5", "5£", "5 dollars", "5", "seven"]
    rows = [(i, f"it is said: {ask.format(x)}. so") for i, x in enumerate(same + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in find_leaks(docs, items).collect()}
    assert got == set(range(len(same)))
    # each kind finds its own
    signs = [(i, ask.format(x)) for i, x in enumerate(("7%", "$7", "7 kg", "7 hours", "7"))]
    items = spark.createDataFrame(signs, "item_id long, text string")
    found = {(same + other)[r.doc_id]: r.item_id for r in find_leaks(docs, items).collect()}
    assert found == {
        "12%": 0, "$5": 1, "€5": 1, "5£": 1, "5 dollars": 1, "8 kg": 2, "5 hours": 3, "5": 4, "seven": 4
    }


def test_templates_against_plain_windows(spark):
    """Benchmark questions with other numbers put in, found by template windows as strings."""
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = np.random.default_rng(2)
    items, docs = [], []
    for i, text in enumerate(texts):
        words = re.sub(r"[^a-z ]", " ", text.lower()).split()[:24]
        place = int(rng.integers(0, len(words)))
        items.append((i, " ".join([*words[:place], "12 km", *words[place:]])))
        docs.append((i, " ".join([*words[:place], f"{13 + i} {'miles' if i % 2 else 'kg'}", *words[place:]])))

    def windows(text):
        kinds = [(r"\d+ (km|miles)", "#l"), (r"\d+ kg", "#m")]
        for pattern, mark in kinds:
            text = re.sub(pattern, mark, text)
        w = text.split()
        return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    expected = {
        (d, i)
        for d, doc in docs
        for i, item in items
        if len(windows(doc) & windows(item)) >= 0.5 * len(windows(item))
    }
    made = [
        spark.createDataFrame(rows, f"{name} long, text string")
        for name, rows in (("doc_id", docs), ("item_id", items))
    ]
    got = {(r.doc_id, r.item_id) for r in find_leaks(*made).collect()}
    assert got == expected and {(i, i) for i in range(1, len(texts), 2)} <= got


def test_leaks_without_literal_words(spark):
    texts = ["The Old Man And The Grey Sea Of Long Ago", "12 + 34 * 56 = 1916 and 7 - 3 = 4",
             "Anna Berg, Carl Dahl, Eva Falk, Georg Holm, Ines Jung", "Apples are red 5 times here"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, f"it is said, {t} and so on") for i, t in enumerate(texts)]
    rows.append((4, "it is said, Apples are red 8 times here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert got == {(i, i) for i in range(4)} | {(4, 3)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_leaks(none, items).count() == 0
    assert find_leaks(none, items.limit(0)).count() == 0


def test_all_benchmark_passages(spark):
    """Against windows of eight words compared as strings."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    windows = {}
    for r in items.collect():
        w = r.text.split()
        for i in range(len(w) - 7):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(r.item_id)
    total = {r.item_id: len(r.text.split()) - 7 for r in items.collect()}
    found = {}
    for r in docs.collect():
        w = r.text.split()
        for i in range(len(w) - 7):
            for item in windows.get(tuple(w[i : i + 8]), ()):
                found.setdefault((r.doc_id, item), set()).add(tuple(w[i : i + 8]))
    sure = {k for k, v in found.items() if len(v) >= 0.7 * total[k[1]]}
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert sure <= got and len(got) <= len(sure) + 3


# ---------------------------------------------------------------- embeddings


def brute_links(rows, threshold):
    units = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v)
        v = np.array(v, dtype=np.float64) if ok else None
        v = v / np.abs(v).max() if ok and np.any(v) else v
        units.append(v / np.linalg.norm(v) if ok and np.any(v) else None)
    links = [set() for _ in rows]
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2]:
                if len(a) == len(b) and a @ b >= threshold:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def test_embeddings_equal_all_pairs(spark):
    draw = np.random.Generator(np.random.PCG64(8))
    rows = []
    for label in (1, 2):
        for spread, n in ((0.04, 60), (0.1, 25), (0.05, 3), (0.02, 2), (1.0, 60)):
            base = draw.normal(size=16)
            rows += [((base + spread * draw.normal(size=16)).tolist(), label) for _ in range(n)]
    rows += [(rows[0][0], 1)] * 4 + [(rows[0][0], 2), (rows[0][0], None)]
    rows += [([0.0] * 16, 1), (None, 1), ([], 1), ([1.0, None], 1), ([float("nan")] * 16, 1),
             ([float("inf"), 1.0], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e300, 2e300], 1), ([1e-300, 2e-300], 1)]
    ids = draw.permutation(len(rows)) + 7
    rows = [(int(i), *r) for i, r in zip(ids, rows, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.selectExpr("*", "1 AS node", "2 AS mult", "'x' AS kept")
    got = embedding_classes(df, tables=3, block=16)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in got] == brute_links(rows, 0.98)
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_tight_groups_inside_a_group(spark):
    """All ten places of a list go to the own tight group, so no list leads to the others."""
    draw = np.random.Generator(np.random.PCG64(5))
    axes = np.linalg.qr(draw.normal(size=(48, 48)))[0]
    rows = [
        axes[0] + 0.123 * axes[g + 1] + draw.normal(size=48) * 0.0033 for g in range(4) for _ in range(15)
    ]
    units = np.array([v / np.linalg.norm(v) for v in rows])
    s = units @ units.T
    np.fill_diagonal(s, -1)
    lists = [(i, int(j), float(s[i, j])) for i in range(60) for j in np.argsort(-s[i])[:10]]
    assert all(u // 15 == v // 15 for u, v, _ in lists) and s[0, 59] > 0.98
    lists = spark.createDataFrame(lists, "u long, v long, s double")
    nodes = [(i, 1, 1, 48, bytearray(v.tobytes())) for i, v in enumerate(units)]
    nodes = spark.createDataFrame(nodes, "node long, cell long, mult long, dim int, blob binary")
    counts, components = _counted(lists, nodes, 0.98, 10, 16)
    assert {r.component for r in components.collect()} == {0}
    assert sorted(map(tuple, counts.collect())) == [(i, int((s[i] >= 0.98).sum())) for i in range(60)]


def test_orders_meet_isolated_pairs(spark):
    draw = np.random.Generator(np.random.PCG64(6))
    n = 10_000
    first, across = draw.normal(size=(2, n, 64))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    across -= (across * first).sum(1, keepdims=True) * first
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    second = 0.983 * first + np.sqrt(1 - 0.983**2) * across
    nodes = [(i, 1, 64, bytearray(v.tobytes())) for i, v in enumerate(np.concatenate([first, second]))]
    nodes = spark.createDataFrame(nodes, "node long, cell long, dim int, blob binary")
    orders = projections(2 * n, 0.98)
    met = [
        _projected(nodes, range(m), 13).filter(f"v = u + {n}").select("u").distinct().count() / n
        for m in (4, orders)
    ]
    print("met in 4 orders, in", orders, met)
    assert met[0] < 0.95 and met[1] > 0.995
    assert projections(1_000_000, 0.98) >= 16


def test_block_pairs_are_dealt_over_the_blocks():
    i, j = np.triu_indices(300, 1)
    left, right = _sides(256 * i, 256 * j)
    assert {frozenset(p) for p in zip(left, right, strict=True)} == {
        frozenset(p) for p in zip(256 * i, 256 * j, strict=True)
    }
    assert max(np.bincount(side // 256).max() for side in (left, right)) < 200


def test_audit_judges_vectors_of_few_links_apart(spark):
    vectors = [[1.0, 0.0]] * 1 + [[0.0, 1.0]] * 1
    near = lambda v, e: [v[0] + e * v[1], v[1] + e * v[0]]
    rows = [near(vectors[0], i / 1000) for i in range(40)] + [near(vectors[1], i / 1000) for i in range(2)]
    nodes = [(i, 1, 1, 2, bytearray(np.array(v).tobytes())) for i, v in enumerate(rows)]
    nodes = spark.createDataFrame(nodes, "node long, cell long, mult long, dim int, blob binary")
    counts = spark.createDataFrame([(i, 39 if i < 40 else 0) for i in range(42)], "node long, n_links long")
    assert audit_recall(nodes, counts, 0.98) == 0.0


def test_no_embeddings(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_classes(none).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 1), (3, None, 1)], none.schema)
    assert sorted(map(tuple, embedding_classes(odd).collect()), key=str) == [(3, 0, 3, True), (None, 0, None, True)]
