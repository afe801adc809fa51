"""The pipeline's stages one by one, each on its own input, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.tables import read
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LINE = "a line that many documents share and that is long enough"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted toxic words, lines, copies and test items, among clean ones."""
    root = str(tmp_path_factory.mktemp("corpus"))
    pick = random.Random(7)
    words = [f"wort{i}" for i in range(3000)]
    items = [" ".join(pick.choices(words, k=30)) for _ in range(5)]
    docs = []
    for i in range(300):
        body = pick.choices(words, k=80)
        if i % 10 == 0:
            body[40:40] = ["Moron"]
        if i % 10 == 1:
            body = [*body[:40], *items[i // 10 % 5].split(), *body[40:]]
        text = " ".join(body)
        if i % 10 == 2:
            text = f"{text}\n{LINE}\nend {i}"
        docs.append(text)
    for i in range(0, 300, 10):  # near copies of the fourth of each ten
        docs.append(" ".join([*docs[i + 3].split()[:-1], "other"]))
    docs += [None, "", docs[4]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def ids(rows) -> set:
    return {r["doc_id"] for r in rows}


def test_stages(spark, corpus):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontaminate", "mix"]
    docs = read(spark, corpus, "documents")
    given = {r["doc_id"]: r for r in docs.collect()}
    step = dict(corpus_pipeline.STAGES)

    out = step["toxicity"](spark, docs, corpus)
    rows = out.collect()
    assert out.columns == COLUMNS and ids(rows) == {i for i in given if not (i < 300 and i % 10 == 0)}
    assert all(r == given[r["doc_id"]] for r in rows)

    out = step["line_dedup"](spark, docs, corpus)
    rows = {r["doc_id"]: r for r in out.collect()}
    want = {d: (n, k) for d, _, n, k in brute.line_dedup([(i, r["text"]) for i, r in given.items()])}
    assert out.columns == COLUMNS and set(rows) == set(given)
    for i, r in rows.items():
        assert (r["text"] != given[i]["text"]) == (want[i][0] > 0) and r["n_chars"] == len(r["text"] or "")
    assert sum(n for n, _ in want.values()) == 29 and rows[292]["text"] == given[292]["text"]

    out = step["near_duplicates"](spark, docs, corpus)
    groups = brute.jaccard([(i, r["text"]) for i, r in given.items()], 5, 8, 10)
    assert out.columns == COLUMNS and ids(out.collect()) == {i for i, (_, c) in groups.items() if c == i}
    assert len(given) - out.count() == 31

    out = step["decontaminate"](spark, docs, corpus)
    assert out.columns == COLUMNS and ids(out.collect()) == {i for i in given if not (i < 300 and i % 10 == 1)}

    out = step["mix"](spark, docs, corpus)
    sizes: dict = {}
    for r in given.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.space_words(r["text"]))
    want = brute.targets(sizes)
    taken: dict = {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 120 for s in sizes)


def test_run_and_empty_tables(spark, corpus, tmp_path):
    rows = corpus_pipeline.run(spark, corpus).collect()
    kept = ids(rows)
    assert not any(i < 300 and i % 10 in (0, 1) for i in kept) and not any(300 <= i < 330 for i in kept)
    for table in ("documents", "labels", "benchmark"):
        read(spark, corpus, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_values_pass(spark, corpus):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "text", None, "s0", 4), (5, "x y z", "en", "s0", 5), (5, "x y z", "en", "s0", 5)], read(spark, corpus, "documents").schema)
    odd = odd.withColumn("c0", F.lit("clash")).withColumn("kept_text", F.lit("clash"))
    docs = odd
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, corpus)
        assert docs.count() == 4, name
        assert docs.columns == odd.columns
