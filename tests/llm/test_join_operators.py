"""Near-duplicates of texts and vectors, components, exact top-k: brute force on small tables."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import jaccard, spherical, topk
from rivulet.llm.components import connected_components, forest, least_labels


def labels_of(n, pairs):
    a, b = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int), np.empty(0, int))
    return least_labels(n, a, b)


# -- components --------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame([*pairs, (None, 1), (2, None), (7, 7)], "src long, dst long")
    want = labels_of(461, pairs)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(want[k] == c for k, c in got.items())
    assert set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(df.limit(0)).count() == 0
    u, v = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert sorted(zip(u, v, strict=True)) == [(1, 3), (1, 5), (8, 9)]


# -- n-gram Jaccard ----------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").translate({k: k + 32 for k in range(65, 91)})
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def near_texts(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(30))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 7)):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        out.append(" ".join(base[: len(base) * 3 // 4]))
        out.append(passage + " " + " ".join(base[:12]))
    return out + [out[0], out[3].upper(), None, "", " \t", "one", "one", "One", "é É x y z w", "a b c d"]


@pytest.mark.parametrize("settings", [{}, {"group_shingles": 60, "hot": 2}, {"group_docs": 3}])
def test_jaccard_join_matches_brute_force(spark, settings, monkeypatch):
    if "group_docs" in settings:
        settings = {}
        monkeypatch.setattr(jaccard, "GROUP_DOCS", 3)
        monkeypatch.setattr(jaccard, "BLOCK_DOCS", 2)
    texts = near_texts()
    df = spark.createDataFrame([(k, t, 1, "k") for k, t in enumerate(texts)], "doc_id long, text string, n int, key string")
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = labels_of(len(sets), pairs)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df, **settings).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert got[k]["n_shingles"] == len(sets[k]) and got[k]["component_id"] == want[k]
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.tolist()))


def test_jaccard_search_by_divide_skip():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(0, 1 << 40, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(25)]
        pairs = [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        u, v = jaccard.search(sets)
        assert (least_labels(25, u, v) == labels_of(25, pairs)).all()
        assert set(map(frozenset, zip(u.tolist(), v.tolist(), strict=True))) <= set(map(frozenset, pairs))


def test_jaccard_search_of_large_groups():
    # Several blocks of documents: two clusters, one of which grows over many sizes, and sets that nearly link.
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    a, b, c = new(120), new(40), new(29)
    sets = [np.unique(np.concatenate([a[: 60 + k // 5], new(2)])) for k in range(300)]
    sets += [b[rng.random(40) < 0.93] for _ in range(200)] + [np.unique(np.concatenate([c, new(9)])) for _ in range(300)] + [np.empty(0, np.uint64)] * 3
    sets = [sets[k] for k in rng.permutation(len(sets))]
    ids = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    has = np.zeros((len(sets), len(ids)), np.float32)
    for k, s in enumerate(sets):
        has[k, [ids[h] for h in s.tolist()]] = 1
    both, size = has @ has.T, has.sum(1)
    links = (100 * both >= 75 * (size[:, None] + size - both)) & (both > 0)
    u, v = jaccard.search(sets)
    want = least_labels(len(sets), *np.nonzero(links))
    assert links[u, v].all() and (least_labels(len(sets), u, v) == want).all()
    assert len(u) == len(sets) - len(set(want.tolist()))  # no link that connects nothing
    given = want.copy()
    given[::2] = -np.arange(1, len(given[::2]) + 1)
    u, v = jaccard.search(sets, given)
    assert links[u, v].all()
    known = [(k, int(np.flatnonzero(given == g)[0])) for k, g in enumerate(given)]
    assert (least_labels(len(sets), np.r_[u, [x for x, _ in known]], np.r_[v, [y for _, y in known]]) == want).all()


def test_jaccard_search_is_linear_in_its_candidates():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 29).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 60, 9).astype(np.uint64)])) for _ in range(4_000)]
    begun = time.process_time()
    assert len(jaccard.search(sets)[0]) == 0
    assert time.process_time() - begun < 5


def test_jaccard_hot_level_follows_the_average_cell():
    assert jaccard._hot_level(np.zeros(8, np.uint8), 200) == int(4 * np.log2(201))
    assert jaccard._hot_level(np.full(8, 40, np.uint8), 200) > 40


def test_jaccard_odd_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (4, "q r s t u v"), (9, "w " * 50_000), (8, None), (7, "a b c d e f")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, None), (3, 3), (3, 3), (4, 3), (9, 9), (8, 8), (7, 3)], key=str)
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert jaccard.near_duplicates(spark.createDataFrame([(1, None)], schema)).first()["component_id"] == 1


def test_jaccard_one_of_each_by_text(spark):
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (7, b, 4), (7, b.upper(), 5), (8, None, 6), (8, None, 7), (None, a, 8), (9, "", 9)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, th int")).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in got) == sorted([("3", a), ("7", b), ("8", ""), ("8", ""), ("None", a), ("9", "")])


def test_jaccard_sends_no_row_for_each_document(spark, monkeypatch):
    # What goes to the executors is a bitmap, not the documents to drop; a short one lets others through, which stay.
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(9))
    rows = [(k, text(k // 3), "s") for k in range(300)] + [(None, text(1), "s"), (900, None, "s"), (901, " ", "s")]
    want = sorted([(str(k), text(k // 3)) for k in range(0, 300, 3)] + [("None", text(1)), ("900", None), ("901", " ")], key=str)
    for bits in (jaccard.FILTER_BITS, 15, 4):
        monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
        kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id int, text string, source string"))
        assert sorted(((str(r["doc_id"]), r["text"]) for r in kept.collect()), key=str) == want
        sent = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "strategy=broadcast" in x]
        assert sent and all("LeftOuter" in x and "__row" in x for x in sent), sent


# -- spherical caps ----------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, cell long, n_links int"


def test_spherical_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([c + rng.normal(size=(n, 32)) * s for c, n, s in zip(centres, [60, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1], [0.1, 0.2, 0.3] * 4, strict=True)] + [rng.normal(size=(80, 32))]).astype(np.float32)
    x[100] = x[101] = x[102]
    x[103] = 2 * x[102]
    rows = [(k, v.tolist(), 0, 1, 1) for k, v in enumerate(x)]
    n = len(rows)
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None] * 16, [float("inf")] + [0.0] * 31, [1.0] * 8]
    df = spark.createDataFrame(rows + [(n + k, v, 0, 1, 1) for k, v in enumerate(bad)], VECTORS)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = u @ u.T >= spherical.COSINE
    np.fill_diagonal(close, False)
    want = least_labels(n, *np.nonzero(close))
    got = {r["vec_id"]: r for r in spherical.near_duplicates(df).collect()}
    assert len(got) == n + len(bad)
    assert all(got[k]["n_links"] <= close[k].sum() for k in range(n))
    found = sum(got[k]["n_links"] for k in range(n))
    assert found >= 0.97 * close.sum()
    assert np.mean([got[k]["component_id"] == want[k] for k in range(n)]) > 0.97
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(n, n + len(bad)))


def test_spherical_blocks_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(spherical, "BLOCK", 8)
    monkeypatch.setattr(spherical, "SMALL", 4)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=32) + rng.normal(size=(40, 32)) * 0.05).astype(np.float32)
    got = spherical.near_duplicates(spark.createDataFrame([(k, v.tolist(), 0, 1, 1) for k, v in enumerate(x)], VECTORS)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(39, 0)}


def test_spherical_decodes_every_filter_that_is_passed():
    code = spherical.make_codes(500, 24)[0]
    rng = np.random.default_rng(1)
    x = spherical._unit(rng.normal(size=(40, 24)))
    y = x @ code.rotation
    row, cell = code.decode(x)
    words = [np.concatenate([code.books[0][i], code.books[1][j]]) for i in range(len(code.books[0])) for j in range(len(code.books[1]))]
    i, c = np.nonzero(y @ np.array(words).T >= code.alpha)
    assert sorted(zip(row, cell, strict=True)) == sorted(zip(i, c, strict=True))


@pytest.mark.parametrize("d", [3, 5, 8, 12])
def test_spherical_codes_of_few_dimensions(d):
    codes = spherical.make_codes(1_000_000, d)
    assert len(codes) < 60 and all(len(book) <= spherical.MOST_WORDS for code in codes for book in code.books)
    rng = np.random.default_rng(d)
    x = spherical._unit(rng.normal(size=(300, d)))
    z = rng.normal(size=(300, d))
    z = spherical._unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    (r, c), (s, e) = spherical.decode(codes, x), spherical.decode(codes, y)
    met = set(zip(r.tolist(), c.tolist(), strict=True)) & set(zip(s.tolist(), e.tolist(), strict=True))
    assert len({k for k, _ in met}) >= 0.97 * 300


def test_spherical_links_just_above_the_threshold(spark):
    # Pairs with a cosine of 0.9 to 0.95, and others with 0.85 to 0.9: the former are found, none of the latter.
    rng = np.random.default_rng(12)
    x = spherical._unit(rng.normal(size=(1500, 48)))
    z = rng.normal(size=(1500, 48))
    z = spherical._unit(z - (z * x).sum(1, keepdims=True) * x)
    cos = np.r_[rng.uniform(0.9001, 0.95, 750), rng.uniform(0.85, 0.8999, 750)][:, None]
    y = cos * x + np.sqrt(1 - cos * cos) * z
    rows = [(k, v.tolist(), 0, 1, 1) for k, v in enumerate(np.concatenate([x, y]))]
    got = {r["vec_id"]: r["n_links"] for r in spherical.near_duplicates(spark.createDataFrame(rows, VECTORS.replace("float", "double"))).collect()}
    assert sum(got[k] for k in range(750)) >= 0.97 * 750 and all(got[k] <= 1 for k in range(750))
    assert sum(got[k] + got[k + 1500] for k in range(750, 1500)) == 0


def test_spherical_odd_tables(spark):
    assert spherical.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, None, 0, 1, 1), (None, [1.0] * 16, 0, 1, 1), (2, [1.0] * 16, 0, 1, 1), (2, [1.0] * 16, 0, 1, 1), (5, [1.0] * 16, 0, 1, 1), (6, [1.0, 2.0], 0, 1, 1), (7, [2.0, 4.0], 0, 1, 1), (8, [1.0] * 5, 0, 1, 1), (9, [1.0] * 4 + [1.1], 0, 1, 1), (10, [3.0], 0, 1, 1)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in spherical.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (None, 0, None), (2, 1, 2), (2, 1, 2), (5, 1, 2), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8), (10, 0, 10)], key=str)


# -- exact top-k -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "vector_block": 20, "pivots": 4}])
def test_top_k_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(9)
    x = rng.integers(-20, 20, size=(120, 6))
    x[30:40] = x[30]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (None, [1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), **blocks).collect()
    want = []
    for q in range(0, 120, 10):
        best = sorted((-int(x[q] @ x[k]), k) for k in range(120) if k != q)[:5]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(best)]
    assert sorted(map(tuple, got)) == want


def brute_top(x, asked, k=5):
    """By Python's integers; the shorter vector goes on with zeros."""
    out = []
    for q in asked:
        best = sorted((-min(max(sum(a * b for a, b in zip(x[q], v, strict=False)), topk.LOWEST), topk.HIGHEST), c) for c, v in x.items() if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("top", [100, 1 << 27, 1 << 40])
def test_top_k_is_exact_for_large_components(spark, top):
    rng = np.random.default_rng(3)
    x = {k: [int(v) for v in rng.integers(top - 50, top, size=5)] for k in range(60)}
    x |= {k: [c + int(e) for c, e in zip(x[k - 60], rng.integers(0, 2, 5), strict=True)] for k in range(60, 90)}
    df = spark.createDataFrame(list(x.items()), "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id % 30 = 0"), pivots=5, vector_block=16)
    assert sorted(map(tuple, got.collect())) == brute_top(x, (0, 30, 60))


def test_top_k_of_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(2)
    x = {k: rng.integers(-9, 9, k % 5).tolist() for k in range(40)}
    rows = [(k, v, 1.0, "n", 2, 3) for k, v in x.items()] + [(90, [1, None], 1.0, "n", 2, 3)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, score double, rank string, cell int, least int")
    got = topk.top_k(df, df.where("vec_id % 8 = 0"), pivots=4, vector_block=4)
    assert sorted(map(tuple, got.collect())) == brute_top(x, range(0, 40, 8))


def test_top_k_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1, 0]), (1, [0, 1]), (2, [5, 1]), (2, [5, 1]), (3, [1, 7]), (4, [0, 0])], "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id = 4"), k=3, vector_block=2)
    assert sorted(map(tuple, got.collect())) == [(4, 1, 1, 0), (4, 2, 1, 0), (4, 3, 2, 0)]
    got = topk.top_k(df, df.where("vec_id = 1"), k=3, vector_block=2)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3, 7), (1, 2, 2, 5), (1, 3, 2, 5)]


def test_top_k_odd_tables(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, [0, 0])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 1")).orderBy("rank").collect()] == [(1, 1, 2, 11), (1, 2, 3, 0)]
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df.where("vec_id = 1"), df.where("vec_id = 1")).count() == 0
    e = spark.createDataFrame([([0.5, -0.1],), ([float("nan")],), ([None],), (None,), ([float("-inf")],)], "e array<float>")
    assert [r["v"] for r in e.select(topk.quantised(F.col("e")).alias("v")).collect()] == [[128, -26], None, None, None, None]
