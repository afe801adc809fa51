"""Each operator against its plain version, on the smallest sample and on awkward rows."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.llm import ctw, decontaminate, embedding_dedup, licenses, line_dedup, mixing, ngram_join, toxicity, url_filter, warc
from tests.conftest import SF
from tests.llm import brute

QUERIES = entry.queries()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def name(n: int) -> str:
    return next(q for q in QUERIES if q.startswith(f"op{n}_"))


def sample(spark, table: str, *columns: str) -> list[tuple]:
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]


LINE = "this line stands in many documents and is long enough to count"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    words = random.Random(5).choices([f"w{i}" for i in range(400)], k=3000)
    texts = [None, "", " \t\n\r\n", "one", "One", "two words", "Two  words", " ".join(words), " ".join(words[:-2]), " ".join([*words, "end"])]
    texts += [f"  {LINE.upper()} \nrow {i}\n{LINE}\r\n" for i in range(6)]
    texts += ["x" * 5000, "é" * 41 + "\n" + "é" * 39, " ".join(words)]
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4], 0) for i, t in enumerate(texts)]
    rows += [(None, LINE, None, None, None), (None, None, None, None, None), rows[10], rows[3]]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("score", "size", "doc", "k1", "_text", "matches", "row", "c0", "kept_text", "n", "key"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_line_dedup(spark, odd_docs):
    got = QUERIES[name(1)](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.line_dedup(sample(spark, "documents", "doc_id", "text")))
    got = line_dedup.dedup_lines(odd_docs)
    assert set(odd_docs.columns) <= set(got.columns)
    got = [tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute.line_dedup(pairs(odd_docs)), key=str)
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


def test_line_dedup_without_screen(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "CONFIRM_ROWS", 0)
    for bound in (1 << 20, -1):
        monkeypatch.setattr(line_dedup, "SCREEN_BYTES", bound)
        got = line_dedup.dedup_lines(odd_docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(brute.line_dedup(pairs(odd_docs)), key=str)


def test_line_index_is_reversible(spark):
    docs = spark.createDataFrame([(i, f"{LINE}\nown {i}") for i in range(8)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark).insert(docs.where("doc_id < 5"))
    before = sorted(tuple(r) for r in index.counts.collect())
    assert before[0][2:] == (5, 4)
    index.insert(docs.where("doc_id >= 5"))
    assert index.counts.first()[2:] == (8, 7)
    index.delete(docs.where("doc_id >= 5"))
    assert sorted(tuple(r) for r in index.counts.collect()) == before
    index.delete(docs.where("doc_id = 4"))
    assert index.counts.count() == 0
    assert index.clean(docs.where("doc_id < 4")).agg(F.sum("n_dropped")).first()[0] == 0
    index.insert(docs.where("doc_id >= 4"))
    assert index.clean(docs).agg(F.sum("n_dropped")).first()[0] == 7


def test_cuckoo_filter():
    import numpy as np

    from ledgerloom.llm.cuckoo import CuckooFilter, build

    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = CuckooFilter.load(build(keys).dump())
    assert f.contains(keys).all()
    assert f.contains(keys + np.uint64(1)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.02


def test_embedding(spark):
    got = {r["vec_id"]: tuple(r)[1:] for r in QUERIES[name(2)](spark, SF).collect()}
    assert got == brute.embedding(sample(spark, "embeddings", "vec_id", "embedding", "label"))
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0], 0),
        (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (11, [None, 1.0], 0), (12, [0.93, math.sqrt(1 - 0.93**2)], 0), (13, [1.0, 0.0, 0.0], 0), (14, [1e300, 1e290], 0),
        (15, [1e-300, 0.0], 0), (16, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("cell", F.lit("x"))
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute.embedding([(i, [x / 1e300 for x in v] if i == 14 else [x * 1e300 for x in v] if i == 15 else v, y) for i, v, y in rows])
    assert got == want
    twice = {tuple(r) for r in embedding_dedup.near_duplicates(df.union(df).union(df.limit(1).withColumn("vec_id", F.lit(None).cast("long")))).collect()}
    assert twice == {(i, *v) for i, v in got.items()} | {(None, 0, None, True)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "HOMES", 16)
    monkeypatch.setattr(embedding_dedup, "OTHERS", 24)
    got = {r["vec_id"]: tuple(r)[1:] for r in QUERIES[name(2)](spark, SF).collect()}
    assert got == brute.embedding(sample(spark, "embeddings", "vec_id", "embedding", "label"))


def test_embedding_cells_split_again(spark, monkeypatch):
    import numpy as np

    for constant, value in (("CELL", 8), ("FAN", 3), ("LEVELS", 3), ("CENTRE_BYTES", 256), ("HOMES", 16), ("OTHERS", 24), ("ROWS", 5), ("SAMPLE", 30)):
        monkeypatch.setattr(embedding_dedup, constant, value)
    levels, split = [], embedding_dedup._split
    monkeypatch.setattr(embedding_dedup, "_split", lambda *a: levels.append(split(*a)) or levels[-1])
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(6, 5))
    rows = [(i, (spots[i % 6] + 0.1 * rng.normal(size=5)).tolist(), i % 2 if i < 150 else 0) for i in range(180)]
    turn = [k * 0.3 for k in range(12)]  # a chain: neighbours link, others do not
    rows += [(200 + k, [math.cos(x), math.sin(x), 0.0, 0.0, 0.0], 2) for k, x in enumerate(turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute.embedding(rows)
    assert len({v[1] for i, v in got.items() if i >= 200}) == 1
    assert len(levels) >= 2 and len(levels[0]) > 1 and levels[1]


def test_jaccard(spark, odd_docs, monkeypatch):
    rows = sample(spark, "documents", "doc_id", "text")
    got = {r[0]: tuple(r)[1:] for r in QUERIES[name(7)](spark, SF).collect()}
    assert got == brute.jaccard(rows)
    own = odd_docs.where("doc_id is not null")
    assert {r[0]: tuple(r)[1:] for r in ngram_join.ngram_components(own).collect()} == brute.jaccard(pairs(own))
    assert ngram_join.ngram_components(odd_docs).where("doc is null and component is null").count() == 1
    assert ngram_join.ngram_components(odd_docs.limit(0)).count() == 0


def test_jaccard_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "CLOSING_BLOCK", 6)
    pick = random.Random(3)
    rows = []
    for g in range(4):
        words = pick.choices([f"v{i}" for i in range(900)], k=120)
        for _ in range(25):
            own = list(words)
            for _ in range(pick.randrange(4)):
                own[pick.randrange(len(own))] = f"u{pick.random()}"
            rows.append((len(rows), " ".join(own)))
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num, den in ((3, 9, 10), (5, 8, 10)):
        got = {r[0]: tuple(r)[1:] for r in ngram_join.ngram_components(df, n=n, num=num, den=den).collect()}
        assert got == brute.jaccard(rows, n, num, den)


def test_jaccard_at_low_thresholds(spark):
    rows = []
    for g in range(60):  # word counts that put sets of linked sizes in size classes apart
        words = [f"g{g}w{i}" for i in range(10 + g % 9)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words, *(f"g{g}x{i}" for i in range(4 + g % 5))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num, den in ((1, 2), (1, 3)):
        got = {r[0]: tuple(r)[1:] for r in ngram_join.ngram_components(df, n=1, num=num, den=den).collect()}
        assert got == brute.jaccard(rows, 1, num, den)


@pytest.mark.parametrize("few", [-1, 1 << 20])
def test_jaccard_of_overlapping_sets(spark, monkeypatch, few):
    """Common passages, edits and copies around the threshold, with lists sent to tasks and with joins."""
    monkeypatch.setattr(ngram_join, "FEW_KEYS", few)
    monkeypatch.setattr(ngram_join, "FEW_IDS", few)
    pick = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(pick.randrange(1, 90))]
        for _ in range(pick.randrange(1, 6)):
            own = list(words)
            for _ in range(pick.randrange(9)):
                own[pick.randrange(len(own))] = f"u{pick.random()}"
            own += [f"x{pick.random()}" for _ in range(pick.randrange(6))]
            if pick.random() < 0.4:
                own = common + own
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[::7])]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num, den in ((3, 9, 10), (5, 8, 10), (2, 1, 2)):
        got = {r[0]: tuple(r)[1:] for r in ngram_join.ngram_components(df, n=n, num=num, den=den).collect()}
        assert got == brute.jaccard(rows, n, num, den)


def test_jaccard_counts_no_linked_set_out():
    """Two linked sets share as many of the shingles they give as either needs."""
    import numpy as np

    rng = np.random.default_rng(4)
    for num, den in ((9, 10), (8, 10), (1, 2), (1, 3)):
        for _ in range(400):
            a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 120)))
            b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.choice([0.6, 0.9, 0.97])], rng.integers(0, 1 << 40, rng.integers(0, 12)))))
            both = len(np.intersect1d(a, b))
            if both and den * both >= num * (len(a) + len(b) - both):
                (qa, na), (qb, nb) = (ngram_join.given(len(x), num, den) for x in (a, b))
                assert len(np.intersect1d(a[:qa], b[:qb])) >= max(na, nb)
        least = ngram_join.size_classes(num, den)
        for n in range(1, 400):
            small, large = (int(np.searchsorted(least, x, "right")) for x in (n, n * den // num))
            assert large - small <= 1


def test_toxicity_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = QUERIES[name(3)](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.002 * len(clean)
    assert all(r["spans"] for r in toxic if r["predicted"])


def test_toxicity_spans_and_odd_rows(spark, odd_docs):
    pick = random.Random(1)
    words = [f"wort{i}" for i in range(60)]
    rows = [(i, "É " + " ".join([*pick.choices(words, k=30), *(["Scumbag"] if i % 3 == 0 else []), *pick.choices(words, k=5)]), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    for r in toxicity.score(docs, model).collect():
        assert (r["score"] >= 0.7) == bool(r["toxic"])
        assert {r["text"][s["start"] : s["end"]] for s in r["spans"]} == ({"Scumbag"} if r["toxic"] else set())
    odd = toxicity.score(odd_docs, model)
    assert set(odd_docs.columns) <= set(odd.columns) and all(0 <= r["score"] <= 1 for r in odd.select("score").collect())
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), docs.select("doc_id", "toxic").limit(0)) == 0.0


def test_chain_equals_all_paths():
    import itertools

    import numpy as np

    model = toxicity.Crf(np.array([1, 2], np.uint64))
    model.bias, model.to, model.back, model.stay = -1.0, 0.3, -0.2, 0.5
    at, emission, n = np.array([1, 4]), np.array([1.2, -0.7]), 6
    z = z_any = 0.0
    marg = np.zeros(2)
    extra = dict(zip(at.tolist(), emission.tolist(), strict=True))
    for path in itertools.product((0, 1), repeat=n):
        logw = sum(model.bias + extra.get(i, 0.0) for i in range(n) if path[i])
        for a, b in zip((0, *path), path, strict=False):
            logw += {(0, 1): model.to, (1, 0): model.back, (1, 1): model.stay}.get((a, b), 0.0)
        z += math.exp(logw)
        z_any += math.exp(logw) if any(path) else 0
        marg += [math.exp(logw) * path[i] for i in at]
    log_ratio, got = model.chain(n, at, emission, model.powers())
    assert math.isclose(log_ratio, math.log(z), rel_tol=1e-9) and math.isclose(1 - math.exp(-log_ratio), z_any / z, rel_tol=1e-9)
    assert np.allclose(got, marg / z)


def test_base_scores(spark):
    got = {r["doc_id"]: r for r in QUERIES[name(4)](spark, SF).collect()}
    want = brute.unigram(sample(spark, "documents", "doc_id", "text"))
    assert set(got) == set(want)
    for d, (held, n, known, total, base) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)


@pytest.mark.parametrize("heads", [None, 1])
def test_ctw_equals_definition(spark, monkeypatch, heads):
    if heads:
        monkeypatch.setattr(ctw, "HEAD_RUNS", heads)
        monkeypatch.setattr(ctw, "HEAD_WORDS", heads)
    rows = [(0, "abracadabra"), (1, "abra kadabra"), (2, None), (3, ""), (4, "cadaver ábra"), (5, "zzz"), (6, "abra"), (6, "abra"), (None, "bra")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("clash"))
    got = ctw.score_documents(df, F.col("doc_id").isin(0, 1, 2, 4)).collect()
    assert len(got) == len(rows)
    train = [(t or "").encode() for d, t in rows if d in (0, 1, 2, 4)]
    text = dict(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] not in (0, 1, 2, 4))
        assert math.isclose(r["score"], brute.ctw(train, (text[r["doc_id"]] or "").encode(), ctw.DEPTH), rel_tol=1e-5, abs_tol=1e-5)
    assert ctw.score_documents(df.limit(0), F.lit(True)).count() == 0


def test_ctw_rare_bit_below_many_counts():
    """A bit that training never saw beside more than 2^24 others keeps its estimate."""
    import numpy as np

    many = 1 << 27
    upper = ctw.Upper(*(np.array([x]) for x in (0, 1, 0.0, float(many), ctw.log_kt(np.array([0.0]), np.array([float(many)]))[0])))
    byte = np.array([0x00, 0xFF], np.uint64)
    first, other = 10 ** upper.log10(byte, np.full((2, 8), -1.0)) * 2**7
    assert math.isclose(first, 0.5 / (many + 1), rel_tol=1e-5) and math.isclose(other, 1, rel_tol=1e-5)


def test_ctw_code_length(spark):
    rows = [(0, "abracadabra"), (1, None), (2, ""), (3, "cadaver ábra")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score_documents(df, F.col("doc_id") == 0).collect()}
    assert {d: r["n_bytes"] for d, r in got.items()} == {0: 11, 1: 0, 2: 0, 3: 13}
    assert got[1]["bits_per_byte"] == got[2]["bits_per_byte"] == 0.0
    for d in (0, 3):
        bits = -brute.ctw([b"abracadabra"], rows[d][1].encode(), ctw.DEPTH) * math.log2(10)
        assert math.isclose(got[d]["bits_per_byte"], bits / got[d]["n_bytes"], rel_tol=1e-5)


def test_licence_scan(spark, odd_docs):
    got = {r["doc_id"]: r for r in QUERIES[name(5)](spark, SF).collect()}
    rows = sample(spark, "documents", "doc_id", "text")
    extra = [
        (1, "Under the MIT License. under the mit\nlicense"), (2, "apache LICENSE, version 2.0"), (3, "CC-BY-NC 4.0"), (4, "under the mit licenses"),
        (5, "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files"),
        (6, "cc by nc " * 3), (7, None), (8, ""), (9, "thé cc by ncé"),
    ]
    for r, t in [*((got[d], t) for d, t in rows)]:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licence(t)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    df = spark.createDataFrame(extra, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("word", F.lit(1))
    for r in licenses.scan(df).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licence(r["text"])
        assert r["doc_id"] != 5 or (r["labels"] == "mit" and 0.7 <= r["score"] < 1)
    assert licenses.scan(odd_docs).count() == odd_docs.count()
    assert licenses.scan(odd_docs.limit(0)).count() == 0


def test_licence_templates_by_brute_force(spark):
    every = licenses.TEMPLATES + licenses.TEXTS
    rng = random.Random(5)
    filler = "river stone harvest the of in and software license terms copy notice".split()
    texts, want = [None, ""], [None, None]

    def around(words: list[str]) -> str:
        return " ".join([*rng.choices(filler, k=rng.randrange(30)), *words, *rng.choices(filler, k=rng.randrange(30))])

    def off_key(words: list[str], must: list[str]) -> list[int]:
        low = [re.sub("[^a-z0-9]", "", x.lower()) for x in words]
        at = next(i for i in range(len(low)) if low[i : i + len(must)] == must)
        return [*range(at), *range(at + len(must), len(words))]

    for label, text, key in every:
        plain = re.findall("[a-z0-9]+", text.lower())
        free = off_key(plain, key.split())
        for change in ("none", "put in", "left out", "replaced", "half", "broken key"):
            w = list(plain)
            if change == "put in" and free:
                w.insert(rng.choice([i for i in free if i == 0 or i - 1 in free]), "newly")
            elif change == "left out" and free:
                del w[rng.choice(free)]
            elif change == "replaced" and free:
                w[rng.choice(free)] = "other"
            elif change == "half":
                w = w[: len(w) // 2]
            elif change == "broken key":
                w = [x for x in plain if x != key.split()[-1]]
            texts.append(around(w))
            want.append(label if change in ("none", "put in", "left out", "replaced") else None)
    texts += [around(rng.choices(filler, k=40)) for _ in range(400)]
    texts.append(" ".join(x for _, t, _ in every for x in t.split()) + " river" * 30_000 + " all rights reserved" * 50)  # a very long text
    texts += texts[-3:]  # repeated rows
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    truth = brute.licence_labels(texts, every, licenses.MIN_SHARE, licenses.SLACK, licenses.DRIFT)
    assert len(got) == len(texts)
    for i, (labels, score) in enumerate(truth):
        assert set(got[i]["labels"].split(",")) - {""} == labels, (i, texts[i])
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9, abs_tol=1e-12), (i, texts[i])
    for i, label in enumerate(want):
        assert label is None or label in got[i]["labels"].split(","), (i, texts[i])


def test_url_filter(spark):
    urls = [u for (u,) in sample(spark, "pages", "url")]
    urls += [None, "", "://", "no scheme.com/en/", "HTTP://WWW.Example.COM/en/", "http://example.com", "http://example.com/en", "x://a.b.net/es/x?y", "x://net/fr/#",
             "x://.com/", "x://com/", "x://a..net/fr/", "x://example.com/en/?a://b", "x://notexample.com/en/", "x://éxample.com/"]
    df = spark.createDataFrame([(u, "clash") for u in urls], "url string, host string").withColumn("rule", F.lit(1))
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute.url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == (verdict or ("allow" if host else "block"))
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, ()).where("host <> ''").collect()} == {"allow"}


def test_warc(spark, monkeypatch):
    got = sorted((tuple(r) for r in QUERIES[name(8)](spark, SF).collect()), key=str)
    assert got == sorted(brute.warc(sample(spark, "pages", "page_id", "html")), key=str)
    monkeypatch.setattr(warc, "CHUNK", 7)
    edge = warc.BOUNDARY
    rows = [
        (3, "http://x/\r\nWARC-Type: evil", "same"), (1, "u", "same"), (2, None, None), (9, "u", ""), (4, "u", edge), (5, "u", f"a{edge}b{edge}{edge}"), (6, "u", "é" * 30 + "\r\n"),
        (7, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n"), (8, "u", "\r\n" * 9 + "WARC/1.1\r\n"), (10, "u", "x" * 6 + edge), (11, "u", "\n\r\n\r"), (12, "u", "\x00\x0b€😀" * 5), (12, "u", "\x00\x0b€😀" * 5),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("key", F.lit(1))
    for chunk in (7, 1000):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
        assert got == sorted(brute.warc([(i, h) for i, _, h in rows]), key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_large_records(spark):
    """One record of 64 MB, one of 200 chunks, and nothing that grows faster than they do."""
    import time

    big = "0123456789abcdé€\r\n" * (64 * (1 << 20) // 22)
    some = "x" * (200 * warc.CHUNK - 5)
    rows = [(1, "u", big), (2, "u", some), (3, "u", some), (4, "u", "small"), (5, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    table = warc.records(df)
    assert {r["page_id"]: r["chunks"] for r in table.select("page_id", "chunks").distinct().collect()} == {1: -(-len(big.encode()) // warc.CHUNK), 2: 200, 3: 1, 4: 1, 5: 1}
    assert table.agg(F.max(F.octet_length("chunk"))).first()[0] <= warc.CHUNK
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted(brute.warc([(i, h) for i, _, h in rows]), key=str)

    def seconds(mb: int) -> float:
        one = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), F.expr(f"repeat('0123456789abcdef', {mb << 16})").alias("html"))
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            warc.records(one).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    seconds(1)
    assert seconds(32) < 2.2 * seconds(16)


def test_warc_cuts():
    pick = random.Random(8)
    parts = ["\r\n", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n", "a", "é", "€", "😀", "WA", "RC/1.1\r\n"]
    for chunk in (4, 5, 9, 30, 1000):
        for _ in range(200):
            data = "".join(pick.choices(parts, k=pick.randrange(12))).encode()
            ends = warc._cuts(memoryview(data), chunk)
            pieces = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            assert b"".join(pieces) == data and all(len(p) <= chunk for p in pieces)
            for p in pieces:
                p.decode()
                framed = b"\r\n\r\n" + p + b"\r\n\r"
                assert warc.BOUNDARY.encode() not in framed


def test_mixing(spark, odd_docs):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        got = mixing.mix_sources(df).collect()
        assert len(got) == df.count()
        sizes: dict = {}
        taken: dict = {}
        for r in got:
            assert r["size"] == len(brute.space_words(r["text"]))
            assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        want = brute.targets(sizes)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        for s in sizes:
            largest = max(r["size"] for r in got if r["source"] == s)
            assert abs(taken[s] - want[s]) <= largest
        again = mixing.mix_sources(df.repartition(5)).collect()
        key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
        assert key(got) == key(again)
    assert mixing.mix_sources(odd_docs.limit(0)).count() == 0


def test_decontamination(spark, odd_docs):
    pick = random.Random(2)
    vocabulary = [f"word{i}" for i in range(2000)]
    items = [(i, " ".join(pick.choices(vocabulary, k=30))) for i in range(20)]
    rows = []
    for d in range(200):
        own = pick.choices(vocabulary, k=300)
        if d % 4 == 0:
            copy = items[d % 20][1].upper().split()
            if d % 8 == 0:  # edited: a fifth of the words replaced, one dropped
                for k in range(0, 30, 5):
                    copy[k] = "changed"
                del copy[13]
            own[100:100] = copy
        if d % 4 == 1:  # a quotation is no copy
            own[50:50] = items[d % 20][1].split()[:7]
        rows.append((d, ", ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, "x y z"), (52, "solo"), (53, items[0][1])], "item_id long, text string")
    got = decontaminate.matched_pairs(docs, bench).collect()
    want = {(d, d % 20) for d in range(0, 200, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] < 20} == want
    assert {(r["doc_id"], 53) for r in got if r["item_id"] == 0} == {(r["doc_id"], 53) for r in got if r["item_id"] == 53}
    assert all(r["first_word"] in (100, 101) for r in got)
    found = decontaminate.contaminated(odd_docs, bench)
    assert found.count() == odd_docs.count() and found.where("size(matches) > 0").count() == 0
    assert decontaminate.matched_pairs(docs.limit(0), bench).count() == 0
    assert decontaminate.matched_pairs(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n_docs, copies", [(200, 2), (200, 40), (3000, 30)])
@pytest.mark.parametrize("exact", [0, 1])
def test_decontamination_finds_frequent_edited_copies(spark, n_docs, copies, exact):
    pick = random.Random(5)
    vocabulary = [f"word{i}" for i in range(2000)]
    items = [(i, " ".join(pick.choices(vocabulary, k=30))) for i in range(3)]
    edited = items[1][1].split()
    for k in range(0, 30, 5):
        edited[k] = "changed"
    del edited[13]
    rows = []
    for d in range(n_docs):
        own = pick.choices(vocabulary, k=40)
        if d < copies:
            own[20:20] = edited
        elif d < copies + exact:
            own[20:20] = items[1][1].split()
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matched_pairs(docs, bench).collect()}
    assert got == {(d, 1) for d in range(copies + exact)}


def test_decontamination_finds_long_passages_of_longer_items(spark):
    pick = random.Random(6)
    vocabulary = [f"word{i}" for i in range(5000)]
    items = [(n, " ".join(pick.sample(vocabulary, k=n))) for n in (59, 400)]
    rows, want = [], set()
    for d, (n, held) in enumerate([(59, 30), (59, 13), (59, 12), (400, 200), (400, 13), (400, 12)]):
        own = pick.choices(vocabulary, k=100)
        own[50:50] = items[n == 400][1].split()[7 : 7 + held]
        rows.append((d, " ".join(own)))
        if held >= 13:
            want.add((d, n, held))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.matched_pairs(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in got} == want
    assert all((r["first_word"], r["last_word"]) == (50, 49 + r["matched"]) and r["score"] < 0.55 for r in got)


def test_alignment():
    import numpy as np

    a, b = np.array([9, 9, 1, 2, 3, 7, 4, 5, 9], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)
    assert decontaminate.align(a, b) == (9, 2, 7)
    assert decontaminate.align(a[:2], b) == (0, -1, -1)
