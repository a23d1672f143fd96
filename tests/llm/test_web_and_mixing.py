"""WARC archives, URL filters, mixing, and the pipeline."""

import base64
import hashlib
import io
import itertools
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import mixing, url_filter, warc_zip
from rivulet.llm.common import cut, new_path

# -- WARC in ZIP -------------------------------------------------------------------------------------------------------
PAGES = "page_id long, url string, html string, refers_to string"


def brute_warc(rows):
    first = {}
    for k, _, html, _ in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    out = []
    for k, _, html, _ in rows:
        raw = (html or "").encode()
        r = first.get(html or "")
        revisit = k is not None and r is not None and r < k
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", r if revisit else None))
    return sorted(out, key=str)


def through(spark, rows, archive_bytes=400):
    pages = warc_zip.with_referents(spark.createDataFrame(rows, PAGES).select("page_id", "url", "html"))
    archives = cut(warc_zip.pack(pages, new_path(spark, "t"), archive_bytes), "m")
    return archives, warc_zip.read(warc_zip.dealt(warc_zip.ranges(archives, 2)))


def test_warc_round_trip(spark):
    rows = [(5, "http://a/1", "x", ""), (3, "http://a/2", "x", ""), (4, None, None, ""), (6, "http://ü/ b", "", ""), (7, "u", "é\r\n\r\nz" * 50, ""), (7, "u", "é\r\n\r\nz" * 50, ""), (None, "u", "x", ""), (8, "v", "y" * 300_000, "")]
    archives, back = through(spark, rows)
    assert archives.count() > 1
    got = back.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_warc(rows)
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for _, _, h, _ in rows}
    for a in archives.collect():
        with zipfile.ZipFile(a["uri"].removeprefix("file:")) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert zlib.decompressobj(31).decompress(z.read(warc_zip.DATA)).startswith(b"WARC/1.1\r\n")


def test_warc_smaller_payloads_are_all_responses(spark):
    rows = [(1, "a", "xy", ""), (2, "a", "xy", ""), (3, "a", "z", ""), (4, "a", "z", "")]
    got = {r["page_id"]: r["refers_to"] for r in warc_zip.with_referents(spark.createDataFrame(rows, PAGES), 2).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None}


def test_warc_empty_table(spark):
    assert through(spark, [])[1].count() == 0


def test_warc_index_stretches(monkeypatch):
    monkeypatch.setattr(warc_zip, "INDEX_BYTES", 5)
    for lines, end in ((7, b"\n"), (6, b"\n"), (7, b""), (1, b"\n"), (0, b"")):
        index = b"\n".join(b"x" * (k % 9) + b"%d" % k for k in range(lines)) + (end if lines else b"")
        got = list(warc_zip.stretches(io.BytesIO(b"head" + index + b"tail"), 4, len(index), 3))
        parts = [(b"head" + index)[a : a + n] for a, n, _ in got]
        assert b"".join(parts) == index and [x.splitlines() for x in parts] == [index.splitlines()[k : k + 3] for k in range(0, lines, 3)]
        assert sum(n for _, _, n in got) == lines


def test_warc_clashing_columns(spark):
    rows = [(k, "u", f"x{k % 3}", "", 1, "s", 2, "t") for k in range(9)]
    df = spark.createDataFrame(rows, PAGES + ", __first long, __sha string, __n int, payload string")
    got = {r["page_id"]: r["refers_to"] for r in warc_zip.with_referents(df).collect()}
    assert got == {k: None if k < 3 else k % 3 for k in range(9)}


def test_zip_directory_of_other_writers():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b.txt", "hello")
        z.comment = b"PK\x05\x06 in a comment"
    data = buffer.getvalue()
    (m,) = warc_zip.directory(io.BytesIO(data), len(data))
    assert (m.name, m.size) == ("a/b.txt", 5) and data[warc_zip.data_at(io.BytesIO(data), m) :][:5] == b"hello"
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"x" * 50), 50)
    with pytest.raises(ValueError):
        warc_zip.read_range(io.BytesIO(b"abc"), 1, 5)


# -- URL filters -------------------------------------------------------------------------------------------------------


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, after = rest[:n].translate({k: k + 32 for k in range(65, 91)}), rest[n:]
    m = next((k for k, c in enumerate(after) if c in "?#"), len(after))
    path = after[:m]
    fit = [(len(r), r, v) for v, r in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/es/1", "https://a.example.org/en/1?x=1#y", "https://example.org/en/2", "http://org/", "http://x.org", "http://forg/", "http://b.com/fr/3", "http://b.com/de/", "http://b.com/d", "http://É.com/de/x", "a://b://c.org/", "http://b.com?x=/de/", "http://casino-win.example.net/en/5", "http://casino-win.example.net/en/5"]


def test_url_rules_match_brute_force(spark):
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, label string")
    got = {r["page_id"]: r for r in url_filter.judge(df, none).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path, rule, verdict = brute_url(u)
        r = got[k]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def brute_rules(rows, settings):
    """{(items, label): (confidence, balanced, support)}: every set of the items that frequent tokens make."""
    urls = [frozenset(t) for t, _ in rows]
    of = {}
    for token in set().union(*urls):
        where = frozenset(k for k, t in enumerate(urls) if token in t)
        if len(where) >= settings.min_support * len(rows):
            of.setdefault(where, []).append(token)
    items = {min(tokens): where for where, tokens in of.items()}
    names = {min(tokens): tuple(sorted(tokens)) for tokens in of.values()}
    labels = [x for _, x in rows]
    all_, got = {}, {}
    for n in range(1, len(items) + 1):
        for some in itertools.combinations(sorted(items), n):
            where = frozenset.intersection(*(items[k] for k in some))
            for lab in set(labels):
                f, base = sum(labels[k] == lab for k in where), labels.count(lab)
                if f < settings.min_support * len(rows):
                    continue
                c, m, z = f / len(where), len(where), settings.z
                all_[some, lab] = c
                here, other = f / base, (m - f) / (len(rows) - base)
                low = (c + z * z / (2 * m) - z * (c * (1 - c) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
                general = any(set(g) < set(some) and k == lab and d >= c for (g, k), d in all_.items())
                if here / (here + other) >= settings.min_confidence and low > base / len(rows) and not general:
                    got[tuple(names[k] for k in some), lab] = (c, here / (here + other), f / len(rows))
    return got


def tokens_of(spark, rows):
    found = spark.createDataFrame([(u,) for u, _ in rows], "url string").select(url_filter.tokens(F.col("url")).alias("t")).collect()
    return [(r["t"], lab) for r, (_, lab) in zip(found, rows, strict=True)]


def test_url_association_rules(spark):
    rows = [(f"http://casino-{k}.net/en/{k}", "block") for k in range(30)] + [(f"http://blog-{k % 7}.net/en/{k}", "allow") for k in range(70)] + [("http://casino-a.net/de/9", "allow")] * 20
    labelled = spark.createDataFrame([(u, x, 1, "t") for u, x in [*rows, (None, "block"), ("http://x", None)]], "url string, label string, row int, items string")
    settings = url_filter.Mining(0.05, 0.8, 1.5)
    rules = url_filter.mine(labelled, settings)
    got = {(tuple(map(tuple, r["tokens"])), r["label"]): (r["confidence"], r["balanced"], r["support"]) for r in rules.collect()}
    want = brute_rules(tokens_of(spark, rows), settings)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert ((("@#", "en"), ("@casino",)), "block") in got and ((("@blog",),), "allow") in got
    assert all(r["anchor"] in r["tokens"] for r in rules.collect())
    pages = spark.createDataFrame([(1, "http://casino-99.net/en/1"), (2, "http://blog-1.net/x"), (3, None), (3, None), (None, "http://casino-b.net/de/2")], "page_id long, url string")
    out = url_filter.classify(pages, rules)
    assert sorted(((r["page_id"], r["mined"]) for r in out.collect()), key=str) == sorted([(1, "block"), (2, "allow"), (3, "allow"), (3, "allow"), (None, "allow")], key=str)
    assert url_filter.judge(pages.limit(0), labelled, settings=settings).count() == 0
    assert url_filter.mine(labelled.where("label = 'block'"), settings).count() == 0


def test_url_rules_of_many_tokens(spark):
    # Each three of a, b, c, d are as often allowed as blocked, 0.85 balanced; all four are always blocked. Then e changes nothing.
    four, five = ("a", "b", "c", "d"), ("a", "b", "c", "d", "e")
    rows = [(f"x://h/{'/'.join(four)}", "block")] * 10 + [(f"x://h/{'/'.join(five)}", "block")] * 10
    rows += [(f"x://h/{'/'.join(t for t in four if t != left)}", "allow") for left in four for _ in range(20)]
    rows += [("x://h/e", "allow")] * 30
    settings = url_filter.Mining(0.05, 0.9, 1.0)
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, label string"), settings)
    got = {(tuple(map(tuple, r["tokens"])), r["label"]): (r["confidence"], r["balanced"], r["support"]) for r in rules.collect()}
    want = brute_rules(tokens_of(spark, rows), settings)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert got[tuple((t,) for t in four), "block"][0] == 1
    pages = spark.createDataFrame([(1, "x://z/a/b/c/d"), (2, "x://z/a/b/c")], "page_id long, url string")
    assert {r["page_id"]: r["mined"] for r in url_filter.classify(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_url_rare_label_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(4)
    rows = [(f"http://{'bad' if k % 20 == 0 else 'good'}-{rng.integers(9)}.net/{rng.choice(['en', 'fr'])}/{k}", "block" if k % 20 == 0 and k % 3 else "allow") for k in range(1200)]
    labelled = spark.createDataFrame(rows, "url string, label string")
    assert {tuple(map(tuple, r["tokens"])) for r in url_filter.mine(labelled).where("label = 'block'").collect()} == {(("@bad",),)}
    n = {(r["label"], r["mined"]): r["n"] for r in url_filter.held_out(labelled).collect()}
    assert n["block", "block"] > 0 and ("block", "allow") not in n and n["allow", "block"] <= 0.1 * n["allow", "allow"]
    noise = labelled.select("url", F.when(F.crc32("url") % 4 == 0, "block").otherwise("allow").alias("label"))
    assert url_filter.mine(noise).count() <= 1


def test_url_tokens_that_always_come_together(spark):
    # Two to the 40th sets of tokens are frequent here; as one item they are one.
    many = "/".join(f"part{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(40))
    rows = [(f"http://h.net/{many}/{k}", "block") for k in range(30)] + [(f"http://h.net/other/{k}", "allow") for k in range(60)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, label string")).where("label = 'block'").collect()
    assert len(rules) == 1 and len(rules[0]["tokens"]) == 1 and len(rules[0]["tokens"][0]) == 40
    pages = spark.createDataFrame([(1, "http://z/partab"), (2, "http://z/x")], "page_id long, url string")
    assert {r["page_id"]: r["mined"] for r in url_filter.classify(pages, spark.createDataFrame(rules, url_filter.RULES_SCHEMA)).collect()} == {1: "block", 2: "allow"}


# -- mixing ------------------------------------------------------------------------------------------------------------
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, start long, s int"


def corpus(spark, sizes):
    rows = []
    for s, (source, n, words) in enumerate(sizes):
        rows += [(1000 * s + k, " ".join(f"w{s}.{k}.{j}" for j in range(words)), "en", source, 1, 1, 1, 1) for k in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_mixing_targets():
    assert np.allclose(mixing.targets(np.array([100, 100, 100]), mixing.weights(3)), [50, 100, 150])
    t = mixing.targets(np.array([1000, 10, 10]), mixing.weights(3))
    assert np.allclose(t, [960, 30, 30])
    assert np.allclose(mixing.targets(np.array([5.0]), mixing.weights(1)), [5])
    assert mixing.targets(np.array([]), mixing.weights(0)).size == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.integers(0, 1000, 7)
        t = mixing.targets(s, mixing.weights(7))
        assert (t <= 3 * s + 1e-9).all() and np.isclose(t.sum(), s.sum())


def test_mixing_draws_and_permutations():
    slots = np.array([100, 0, 37])
    d = mixing.draws(slots, 5)
    assert (d.sum(0) == slots).all() and (d >= 0).all() and (d == mixing.draws(slots, 5)).all()
    for n in (1, 2, 17, 1000):
        for key in (1, 2):
            assert sorted(mixing.permuted(np.arange(n), n, key)) == list(range(n))
            assert (mixing.permuted(mixing.permuted(np.arange(n), n, key), n, key, back=True) == np.arange(n)).all()
    assert (mixing.permuted(np.arange(1000), 1000, 1) != mixing.permuted(np.arange(1000), 1000, 2)).any()


def test_mix_slots_have_the_words_asked_for():
    for size in (1, 7, 8, 9, 40, 41, 47, 200):
        for source in range(5):
            blocks = -(-size // 8)
            length = np.full(blocks, 8)
            length[-1] = size - 8 * (blocks - 1)
            for want in range(0, 3 * size + 1, 1 + size // 20):
                n, last = mixing.slots_for(want, size, 8, 17, source)
                at = np.arange(n)
                block = [int(mixing.permuted(np.array([k % blocks]), blocks, mixing.pass_key(17, source, k // blocks))[0]) for k in at]
                assert sum(length[b] for b in block[:-1]) + last == want and (not n or 0 < last <= length[block[-1]])


def brute_mix(rows, block_words, seed):
    """Words taken of each row of (doc_id, source, size, place in its source), from the slots one by one."""
    names = sorted({s for _, s, _, _ in rows}, key=lambda x: (x is None, x or ""))
    sizes = np.array([sum(n for _, s, n, _ in rows if s == name) for name in names])
    target = mixing.targets(sizes, mixing.weights(len(names)))
    taken = dict.fromkeys(range(len(rows)), 0)
    for i, (name, size) in enumerate(zip(names, sizes.tolist(), strict=True)):
        owner = [k for start, k in sorted((start, k) for k, (_, s, n, start) in enumerate(rows) if s == name and n) for _ in range(rows[k][2])]
        blocks, left, slot = -(-size // block_words), round(target[i]), 0
        while left:
            b = int(mixing.permuted(np.array([slot % blocks]), blocks, mixing.pass_key(seed, i, slot // blocks))[0])
            for k in owner[b * block_words : (b + 1) * block_words][:left]:
                taken[k] += 1
                left -= 1
            slot += 1
    return taken


def test_mix_matches_brute_force(spark):
    df = corpus(spark, [("b", 40, 50), ("a", 30, 21), (None, 5, 30), ("c", 1, 0), ("d", 3, 9), ("ä", 11, 13)])
    out, pieces, _ = mixing.mix(df, block_words=16)
    start = {(r["doc_id"], r["s"]): r["start"] for r in pieces.collect()}
    got = out.collect()
    names = sorted({r["source"] for r in got}, key=lambda x: (x is None, x or ""))
    want = brute_mix([(r["doc_id"], r["source"], r["size"], start.get((r["doc_id"], names.index(r["source"])), 0)) for r in got], 16, mixing.SEED)
    assert [r["taken"] for r in got] == [want[k] for k in range(len(got))]


def test_mix_small_source_meets_its_target(spark):
    df = corpus(spark, [("a", 40, 500), ("b", 3, 400), ("c", 2, 300)])
    by = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(df)[0].groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert all(abs(t - n) <= 0.5 for t, n in by.values()) and by["b"][0] > 1000


def test_mix_meets_targets_and_reruns_agree(spark):
    df = corpus(spark, [("b", 40, 50), ("a", 30, 20), (None, 5, 30), ("c", 1, 0)])
    out, pieces, slots = mixing.mix(df, block_words=16)
    rows = out.collect()
    assert len(rows) == 76
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        x[0] += r["size"]
        x[3] += r["taken"]
    for size, total, target, taken in by.values():
        assert size == total and abs(taken - target) <= 0.5
    assert {k: round(v[2], 6) for k, v in by.items()} == {"a": 766.666667, "b": 1533.333333, None: 450.0, "c": 0.0}
    used = {(r["s"], r["block"], r["pass"]) for r in slots.collect()}
    assert len(used) == slots.count()
    again, _, _ = mixing.mix(df.repartition(5), block_words=16)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_mixed_texts_have_the_words_taken(spark):
    df = corpus(spark, [("b", 12, 50), ("a", 9, 20), ("c", 4, 7)])
    rows = mixing.mixed(df, block_words=8)
    assert rows.columns == df.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block_words=8)[0].collect()}
    n, whole = {}, {r["doc_id"]: r["text"].split() for r in df.collect()}
    for r in rows.collect():
        words = r["text"].split()
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + len(words)
        assert r["n_chars"] == len(r["text"]) and set(words) <= set(whole[r["doc_id"]]) and len(set(words)) == len(words)
    assert n == {k: v for k, v in taken.items() if v}


def test_mix_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed(empty).count() == 0
    rows = [(None, None, None, None, None, 0, 0, 0), (1, "a b c", "x", None, 1, 0, 0, 0), (1, "a b c", "x", None, 1, 0, 0, 0), (1, "d e f", "x", None, 1, 0, 0, 0), (2, "g " * 30_000, "x", "s", 1, 0, 0, 0), (3, " \n", "x", "s", 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df)[0].collect()
    assert len(got) == 6 and sum(r["taken"] for r in got if r["doc_id"] in (3, None)) == 0
    assert sorted(r["size"] for r in got) == [0, 0, 3, 3, 3, 30_000]
    assert mixing.mixed(df).count() >= 4


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from rivulet.llm import bpe, jaccard, pii

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == columns
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality_classifier"].collect()}
    assert len(kept) < n and np.mean([(k in kept) == (q == 1) for k, q in quality.items()]) > 0.9
    groups = jaccard.near_duplicates(seen["quality_classifier"]).collect()
    assert {r["doc_id"] for r in seen["ngram_jaccard_join"].collect()} == {r["component_id"] for r in groups}
    assert seen["pii"].count() == seen["ngram_jaccard_join"].count()
    assert pii.pseudonymised(seen["pii"], "k").where("n_found > 0").count() == pii.pseudonymised(seen["ngram_jaccard_join"], "k").where("n_found > 0").count()
    tokens = seen["byte_bpe"]
    import public_tokenizers as P

    back = bpe.decode(tokens, P.path(bpe.VOCABULARY), P.PATTERN).select(F.decode("decoded", "utf-8").alias("text"))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in seen["mix_sources"].collect())


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, key string, __found int, size int"


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline
    from rivulet.llm import quality

    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").select("text").limit(3).collect()
    a, b, c = (r["text"] for r in good)
    texts = [(1, a), (1, a), (2, a), (2, b), (None, a), (3, None), (4, ""), (5, " \n "), (6, c + " jo.doe@mail.org " + c), (7, "word " * 60_000), (8, "x" * 200_000), (9, b)]
    rows = [(k, t, None if k == 9 else "en", None if k in (2, 9) else "s", 1, 1.0, "i", "k", 1, 2) for k, t in texts]
    sf = str(tmp_path)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = spark.createDataFrame(rows, ODD_DOCS)
    for name, table in (("documents", docs), ("labels", labels.limit(0))):
        table.write.parquet(f"{sf}/{name}.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        was, seen = seen, cut(stage(spark, seen, sf), name)
        if name != "byte_bpe":
            assert seen.columns == docs.columns
        else:
            assert seen.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
        if name == "quality_classifier":
            # Without labels all documents have the same score.
            assert seen.count() in (0, len(rows))
            seen = docs
        if name == "ngram_jaccard_join":
            got = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in seen.collect())
            assert got == sorted([("1", len(a)), ("2", len(b)), ("None", len(a)), ("3", 0), ("4", 0), ("5", 3), ("6", len(rows[8][1])), ("7", 300_000), ("8", 200_000)])
        if name == "pii":
            assert seen.count() == was.count() and seen.where("text like '%jo.doe@mail.org%'").count() == 0
            assert {r["doc_id"] for r in seen.where("text is null").collect()} == {3}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
    assert quality.good(docs, labels).columns == docs.columns


def test_pipeline_matches_its_stages_by_brute_force(spark):
    """`run` on the smallest table: near-duplicates, the words of the mix and the tokens, recounted from the stages' inputs."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    from rivulet.llm import bpe, pii, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.good(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    sets = []
    for r in kept:
        w = r["text"].translate({k: k + 32 for k in range(65, 91)}).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    by_shingle = {}
    for k, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j in {j for x in s for j in by_shingle[x] if j < k}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                root[top(k)] = top(j)
    least = {}
    for k, r in enumerate(kept):
        least[top(k)] = min(least.get(top(k), r["doc_id"]), r["doc_id"])
    ids = {r["doc_id"] for k, r in enumerate(kept) if r["doc_id"] == least[top(k)]}
    clean = pii.pseudonymised(docs.where(F.col("doc_id").isin(sorted(ids))), pii.key_of(spark)).select(*docs.columns)
    clean = cut(clean, "clean")
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(clean)[0].collect()}
    assert want.keys() == ids
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    got, n = corpus_pipeline.run(spark, sf).collect(), {}
    for r in got:
        text = enc.decode(r["ids"])
        assert enc.encode_ordinary(text) == r["ids"] and r["n_tokens"] == len(r["ids"])
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + len([w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w])
    assert n == {k: v for k, v in want.items() if v}
