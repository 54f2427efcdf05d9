import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkledger.llm")

import corpus_pipeline  # noqa: E402
from inkledger.llm import shingles  # noqa: E402


def brute(texts):
    """Texts' components by 0.8 of their five-word shingles."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def planted():
    rng, texts = np.random.default_rng(7), [None, "", " \n", "One two", "one  TWO", "one two three"]
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 220)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.choice(220, edits, replace=False):
                copy[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(copy))
            base = copy if k < 4 else base  # chains
    return texts


@pytest.mark.parametrize("tile", [512, 4])
def test_near_classes(spark, tile):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows, linked = shingles.near_classes(df, tile=tile)
    of = rows.join(linked, "id", "left").select("key", F.coalesce("class", "id").alias("class")).collect()
    least = {}
    for r in sorted(of):
        least.setdefault(r["class"], r.key)
    got = {r.key: least[r["class"]] for r in of}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_near_duplicates_stage(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("_id", F.lit("x"))
    out = corpus_pipeline.keep_one_of_each(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(brute(texts)))
    assert corpus_pipeline.keep_one_of_each(spark, df.limit(0), "").count() == 0


def test_repeated_rows_and_keys(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base), (3, base), (None, base), (3, base + " more"), (None, None), (None, None), (5, ""), (7, "w1 " * 30_000), (7, "other words here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_r1", F.lit("x")).withColumn("key", F.lit("x"))
    out = shingles.keep_one(df)
    kept = out.collect()
    assert out.columns == df.columns and all(r._r1 == r.key == "x" for r in kept)
    assert sorted(r.doc_id for r in kept) == [3, 5, 7, 7] and len({r.text for r in kept}) == 4


def test_rows_are_dealt_without_the_joins_before(spark, monkeypatch):
    plans, deal = [], shingles.deal
    monkeypatch.setattr(shingles, "deal", lambda keyed, *a: (plans.append(keyed._jdf.queryExecution().optimizedPlan().toString()), deal(keyed, *a))[1])
    docs = spark.createDataFrame(list(enumerate(planted())), "doc_id bigint, text string")
    shingles.near_classes(docs)
    assert plans and all("Join" not in x for x in plans)
