"""Small inputs on which the operators once did less than the whole job."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.llm import divergence, order_minhash, weak_quality

SF = "/root/testdata/sf0.001"


def own_words(rng, n, kind):
    return [f"{kind}{rng.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("part", [1000, 40])
def test_copies_among_quotations(spark, monkeypatch, part):
    """Two copies of a passage, in buckets whose centre is always one of many longer texts that quote it."""
    monkeypatch.setattr(order_minhash, "PART", part)
    rng = random.Random(11)
    rows, pairs = [], []
    for p in range(3):
        passage = own_words(rng, 100, "p")
        copy = passage[:50] + ["changed"] + passage[51:]
        pairs.append((1000 * p, 1000 * p + 1))
        rows += [(1000 * p, " ".join(passage)), (1000 * p + 1, " ".join(copy))]
        rows += [(1000 * p + k, " ".join(passage + own_words(rng, 60, "q"))) for k in range(2, 302)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert [got[b] for _, b in pairs] == [a for a, _ in pairs]
    assert len(set(got.values())) == len(rows) - len(pairs)


def test_scattered_changes(spark):
    """Pairs at similarities from 0.8 to 0.85, all verified by alignment, with changes at random places."""
    rng = random.Random(12)
    rows = []
    for k in range(120):
        n = (30, 50, 100, 300)[k % 4]
        a = own_words(rng, n, "a")
        b = list(a)
        for at in rng.sample(range(n), n * (15 + k % 6) // 100):
            b[at] = own_words(rng, 1, "b")[0]
        numbers = [np.array([hash(w) & (1 << 62) - 1 for w in x], np.uint64) for x in (a, b)]
        with np.errstate(over="ignore"):
            assert order_minhash.similar(*numbers)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(120))
    print("found", found, "of 120")
    assert found >= 117


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_wrong_language_and_no_common_words(spark):
    """Usual letters and punctuation, but the words of another language or none of the common ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    shift = F.when(F.col("lang") == "en", "de").otherwise("en")
    wrong = docs.where("lang in ('de', 'es', 'fr')").limit(12).select(F.col("doc_id") + 10**9, "text", shift.alias("lang"))
    rng = random.Random(5)
    bare = [(2 * 10**9 + k, " ".join(rng.choice(["river", "stone", "walks", "green", "light", "old"]) + "aeiounst"[rng.randrange(8)] + "lmnrst"[rng.randrange(6)] for _ in range(150)) + ".", "en") for k in range(5)]
    rows = docs.unionByName(wrong.toDF("doc_id", "text", "lang")).unionByName(spark.createDataFrame(bare, docs.schema))
    got = {r.doc_id: r for r in divergence.judge(rows).collect()}
    odd = [r for k, r in got.items() if k >= 10**9 and r.word_distance is not None]
    assert len(odd) >= 10 and not any(r.kept for r in odd), odd
    assert all(r.class_distance < divergence.Limits().class_distance for k, r in got.items() if k >= 2 * 10**9)
    usual = [r for k, r in got.items() if k < 10**9 and not r.base_failed]
    assert sum(r.kept for r in usual) > 0.8 * len(usual)


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """600 copies of the text with the smallest hash, and 400 other texts."""
    rng = random.Random(6)
    texts = spark.createDataFrame([(" ".join(own_words(rng, 30, "w")),) for _ in range(401)], "text string")
    place = F.pmod(F.xxhash64(F.col("text").cast("binary"), F.lit(5)), F.lit(1 << 30))
    texts = [r.text for r in texts.orderBy(place).collect()]
    docs = spark.createDataFrame([(t,) for t in texts[:1] * 600 + texts[1:]], "text string")
    seen = []
    monkeypatch.setattr(weak_quality, "MOST_TEXTS", 50)
    monkeypatch.setattr(weak_quality, "fit_scorer", lambda rows, good: seen.extend(rows) or (np.zeros(weak_quality.SPACE), 0.0))
    weak_quality.train(docs)
    assert len(seen) == len({r[0].tobytes() for r in seen}) and len(seen) >= 40
