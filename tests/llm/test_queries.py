"""The queries against brute force, SQL or held-out labels, and the pipeline's stages against plain versions."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxwright.llm import divergence, order_minhash, phrase_index, queries, shards, token_pack, toxicity, warc, weak_quality

SF = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@needs_tables
@pytest.mark.parametrize(("name", "tables"), [("op5_warc", ["pages"]), ("op6_chat", ["conversations"]), ("op2_decontaminate", ["documents", "benchmark"]), ("op9_quality_rules", ["documents"])])
def test_sql(spark, name, tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    place = [[c[0] for c in found.description].index(c) for c in out.columns]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(tuple(r[k] for k in place)) for r in found.fetchall())


def plain_grams(text):
    """The features one n-gram at a time."""
    raw, mask, out = list(text), 0xFFFFFFFF, []
    kinds = [65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 200 if c >= 128 else c for c in raw]
    for salt, x in ((1, raw), (2, kinds)):
        for n in (1, 2, 3, 4):
            if n == 2 and salt == 1:
                continue
            for k in range(len(x) - n + 1):
                h = x[k] + salt * 257
                for c in x[k + 1 : k + n]:
                    h = (h * 0x01000193 & mask) ^ c
                out.append((h * 0x9E3779B1 & mask) >> 16)
    return out


@needs_tables
def test_quality_query(spark):
    rows = documents(spark)
    model, weights, bias = weak_quality.train(spark.createDataFrame(rows))
    got = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    w = weights.astype(np.float32).astype(float)
    for r in rows[:60]:
        raw = (r.text or "").encode()
        own = plain_grams(raw)
        made = weak_quality.grams(raw)
        # the share of repeats is one more feature of a long text, as often as it has bytes
        rest = collections.Counter(made.tolist()) - collections.Counter(own)
        assert len(rest) <= 1 and len(made) - len(own) in (0, len(raw))
        score = 1 / (1 + math.exp(-(np.mean([w[k] for k in made.tolist()]) + bias))) if len(made) else 1 / (1 + math.exp(-bias))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-6)
        assert got[r.doc_id].kept == (got[r.doc_id].score >= weak_quality.LEAST_SCORE)
    assert len(got) == len(rows) and 0.02 <= model.good <= 0.98


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    count = lambda rows, *by: {tuple(r[:-1]): r[-1] for r in rows.groupBy(*by).count().collect()}
    toxic = count(queries.op8_toxicity(spark, LARGE).join(labels, "doc_id").where("held_out"), "toxic", "predicted")
    assert toxic[1, 1] >= 0.8 * (toxic[1, 1] + toxic.get((1, 0), 0)), toxic
    assert toxic[1, 1] >= 0.95 * (toxic[1, 1] + toxic.get((0, 1), 0)), toxic
    # the quality labels are never used
    kept = count(queries.op1_quality(spark, LARGE).join(labels, "doc_id"), "quality", "kept")
    assert kept[1, True] >= 0.99 * (kept[1, True] + kept.get((1, False), 0)), kept
    assert kept[0, False] >= 0.85 * (kept[0, False] + kept[0, True]), kept


@needs_tables
def test_packing_of_all_documents(spark):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: plain.encode_ordinary(r.text or "") for r in documents(spark)}
    got = {r.doc_id: r for r in queries.op3_pack(spark, SF).collect()}
    assert {k: (r.n_tokens, r.ids_sha256, r.whole) for k, r in got.items()} == {
        k: (len(v), hashlib.sha256(np.array(v, np.uint16).tobytes()).hexdigest(), True) for k, v in want.items()
    }
    for s in token_pack.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        ids = np.frombuffer(s.ids, np.uint16)
        edge, owner, start, resets = (np.frombuffer(s[c], np.int32) for c in ("cu_seqlens", "seg_doc", "seg_start", "position_resets"))
        assert len(ids) == s.n_rows * s.row_tokens == edge[-1] and (resets == edge[:-1]).all()
        for k, d in enumerate(owner.tolist()):
            a, b = edge[k], edge[k + 1]
            assert a // s.row_tokens == (b - 1) // s.row_tokens  # no segment crosses a row
            if d < 0:
                assert (ids[a:b] == s.pad_id).all()
            else:
                assert ids[a:b].tolist() == want[s.doc_ids[d]][start[k] : start[k] + b - a]


@needs_tables
def test_mix_solves_the_dual(spark):
    docs = documents(spark)
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in docs}
    by = collections.defaultdict(list)
    for r in docs:
        by[r.source].append(r.doc_id)
    rows = {r["row"].doc_id: r for r in queries.mix(spark.createDataFrame(docs, DOCS), carry=["doc_id"]).collect()}
    for ids in by.values():
        n = np.array([size[i] for i in ids], float)
        goal = rows[ids[0]].target
        rates = np.array([rows[i].rate for i in ids])
        if 0 < goal < 2 * n.sum() * (1 - 1e-9):
            low, high = -60 / n.min().clip(1), 60.0
            for _ in range(200):
                middle = (low + high) / 2
                with np.errstate(over="ignore"):
                    words = (2 * n / (1 + np.exp(-np.clip(middle * n, -700, 700)))).sum()
                low, high = (low, middle) if words > goal else (middle, high)
            assert np.allclose(rates, 2 / (1 + np.exp(-np.clip(low * n, -700, 700))), atol=1e-3)
        taken = sum(rows[i].copies * size[i] for i in ids)
        assert abs(taken - goal) <= max(1, sorted(n)[len(n) // 4]), (taken, goal)
        # of documents of one size, none is taken two times more often than another
        copies = collections.defaultdict(set)
        for i in ids:
            copies[size[i]].add(rows[i].copies)
        assert all(max(c) - min(c) <= 1 for c in copies.values())


@needs_tables
def test_shards_are_minimax(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = shards.plan_shards(docs, 12).collect()
    groups, shard_of = collections.Counter(), {}
    for r in rows:
        groups[r.hash] += r.size
        shard_of[r.hash] = r.shard
    order = sorted(groups, key=lambda h: ((h % (1 << 64)) >> 48, h))
    loads = collections.Counter()
    for h, n in groups.items():
        loads[shard_of[h]] += n
    # a group above an even share has a shard of its own; the others are cut at the least capacity, found by trying all cuts
    alone = {s for s in loads if sum(shard_of[h] == s for h in groups) == 1 and loads[s] > sum(groups.values()) / 12}
    rest = [groups[h] for h in order if shard_of[h] not in alone]
    best = [0.0] + [math.inf] * len(rest)
    prefix = np.concatenate([[0], np.cumsum(rest)])
    for _ in range(12 - len(alone)):
        best = [0.0] + [min(max(best[i], prefix[j] - prefix[i]) for i in range(j + 1)) for j in range(1, len(rest) + 1)]
    assert max(v for s, v in loads.items() if s not in alone) == best[-1]
    assert [shard_of[h] for h in order if shard_of[h] not in alone] == sorted(shard_of[h] for h in order if shard_of[h] not in alone)
    odd = docs.select("doc_id", "text", F.lit(1).alias("size")).unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(2).alias("size")))
    shards.write_shards(odd, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == odd.count() and back.drop("_shard").exceptAll(odd).count() == 0
    assert back.groupBy("text").agg(F.countDistinct("_shard").alias("n")).where("n > 1").count() == 0


def test_warc_of_a_repeated_page_id(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "bbbbbb"), (3, "v", "bbbbbb"), (4, "v", None), (5, "v", "")], "page_id long, url string, html string")
    out = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.error) for r in warc.archived_pages(pages).collect())
    assert out == [(1, 1, "response", None, None), (1, 6, "response", None, None), (3, 6, "revisit", 1, None), (4, 0, "response", None, None), (5, 0, "revisit", 4, None)]


def plain_distance(a, b):
    p, q = np.array(a, float) / sum(a), np.array(b, float) / sum(b)
    m = (p + q) / 2
    part = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


@needs_tables
def test_rules_distances_and_verdicts(spark):
    limits, rows = divergence.Limits(), documents(spark)
    points, symbols, counted = ".,;:!?'\"()-", "=+_/\\^~`@[]{}", "#*$%&|<>"
    kinds = [str.islower, lambda c: c in " \t\n\x0b\x0c\r", str.isupper, str.isnumeric, lambda c: c in points, lambda c: c in counted, lambda c: c in symbols]

    def counts(text, lang):
        classes = [0] * 8
        for c in text:
            classes[next((k for k, f in enumerate(kinds) if f(c)), 7)] += 1
        words = re.findall("[^\x20\x09-\x0d]+", text)
        plain = collections.Counter(w.strip(divergence.MARKS).lower() for w in words)
        common = [plain[w] for w in divergence.COMMON_WORDS.get(lang, [])]
        return classes, [*common, len(words) - sum(common)], len(words)

    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, SF).collect()}
    made = {r.doc_id: (r.lang if r.lang in divergence.COMMON_WORDS else "", *counts(r.text or "", r.lang)) for r in rows}

    def distances(ids):
        sums = collections.defaultdict(lambda: [np.zeros(8), np.zeros(13)])
        for i in ids:
            lang, classes, common, _ = made[i]
            sums[lang][0] += classes
            sums[lang][1][: len(common)] += common
        out = {}
        for i, (lang, classes, common, n) in made.items():
            a, b = sums[lang] if lang in sums else (np.zeros(8), np.zeros(13))
            x = plain_distance(classes, a) if sum(classes) >= limits.class_least_chars and sum(a) else None
            y = plain_distance(common, b[: len(common)]) if n >= limits.word_least_words and lang and sum(b) else None
            out[i] = (x, y, (x or 0) > limits.class_distance or (y or 0) > limits.word_distance)
        return out

    passed = [i for i in made if not got[i].base_failed]
    first = distances(passed)
    last = distances([i for i in passed if not first[i][2]])
    for i, (x, y, far) in last.items():
        assert got[i].class_distance == pytest.approx(x, abs=2e-3) if x is not None else got[i].class_distance is None
        assert got[i].word_distance == pytest.approx(y, abs=1e-9) if y is not None else got[i].word_distance is None
        assert got[i].kept == (not got[i].base_failed and not far)


def similar_pairs(texts):
    """All pairs of different texts that are similar, by alignment of every pair of fitting length."""
    hashes = order_minhash._Hashes()
    words = [phrase_index.words_of(t.encode()) for t in texts]
    numbers = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in words]
    with np.errstate(over="ignore"):
        for x in range(len(texts)):
            for y in range(x + 1, len(texts)):
                if len(numbers[x]) and len(numbers[y]) and order_minhash.similar(numbers[x], numbers[y]):
                    yield x, y


@needs_tables
def test_near_duplicates_of_all_pairs(spark):
    """No pair is left out, and no class is larger than its links make it."""
    rows = documents(spark)
    texts = sorted({r.text for r in rows if r.text is not None})
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in similar_pairs(texts):
        group[find(x)] = find(y)
    at = {t: find(k) for k, t in enumerate(texts)}
    want = collections.defaultdict(set)
    for r in rows:
        want[at[r.text]].add(r.doc_id)
    got = collections.defaultdict(set)
    for r in queries.op10_near_duplicates(spark, SF).collect():
        got[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items()) and len(got) < len(rows)


def test_stages_against_plain_versions(spark, tmp_path):
    """Null and repeated ids, null texts, copies and benchmark passages: each stage judged row by row."""
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base = [text(40) for _ in range(8)]
    changed = base[1].replace(base[1].split()[20], "other", 1)
    leak = text(14)
    rows = [
        (1, base[0], "en", "a", 1), (1, base[1], "en", "a", 2), (2, base[1], "en", "b", 3), (None, base[1], "en", "b", 4),
        (3, changed, "en", "a", 5), (None, base[2], "de", "a", 6), (None, base[2], "de", "a", 6), (None, base[3], None, None, None),
        (4, None, "en", "a", 7), (4, None, "en", "a", 7), (None, None, None, None, None), (5, f"{base[4]} {leak}", "en", "b", 8),
        (None, f"{leak} {base[5]}", "en", "b", 9), (5, base[6], "en", "b", 10), (6, "", "en", "a", 0), (7, "", "en", "a", 0),
        (None, f"{base[7]} {' '.join(leak.split()[:9])}", "en", "a", 11),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_key", F.lit(1)).repartition(3)
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = lambda df: sorted(map(str, map(tuple, df.collect())))
    smallest = lambda same: min(same, key=lambda r: (r[0] is None, r[0] or 0, str(r[2:])))
    # one of each class: the row with the smallest id, of the text that has it
    classes = [{base[1], changed}, *({t} for t in {r[1] for r in rows if r[1] is not None} - {base[1], changed})]
    want = [r for r in rows if r[1] is None] + [smallest([r for r in rows if r[1] in c]) for c in classes]
    assert got(corpus_pipeline.one_of_each(spark, docs, str(tmp_path))) == sorted(map(str, want))
    want = [r for r in rows if leak not in (r[1] or "")]
    assert got(corpus_pipeline.decontaminated(spark, docs, str(tmp_path))) == sorted(map(str, want))
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    copies = collections.Counter()
    for r in corpus_pipeline.mix(docs.select(*corpus_pipeline.COLUMNS)).collect():
        copies[str(tuple(r["row"]))] += r.copies
    assert collections.Counter(got(mixed)) == +copies and len(copies) == len({str(r) for r in rows})
    kept = got(corpus_pipeline.quality(spark, docs, str(tmp_path)))
    scored = weak_quality.scored(docs.select(*corpus_pipeline.COLUMNS)).collect()
    assert kept == sorted(str(tuple(r["row"])) for r in scored if r.score >= weak_quality.LEAST_SCORE)
    shards_ = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, (d for s in shards_ for d in s.doc_ids))) == sorted(str(r[0]) for r in rows)


@needs_tables
def test_toxicity_scores_again(spark):
    """Every score from dense matrices and plain Python: the samples hold all texts of these tables, so nothing is left to chance."""
    import struct

    xxhash = pytest.importorskip("xxhash")
    folder = SF.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.toxic is not None}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    number = lambda text: {zlib.crc32(w) % toxicity.SPACE for w in phrase_index.words_of((text or "").encode())}
    learned = {i: t for i, t in marks.items() if not out(i)}
    prior = sum(learned.values()) / len(learned)

    def place(text):
        h = 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<i", 11), seed=h).intdigest()
        return h % (1 << 30), h - (1 << 64 if h >> 63 else 0)

    def sample(chosen):
        texts = sorted({r.text for r in rows if chosen(r.doc_id)}, key=place)
        return list(dict.fromkeys(frozenset(number(t)) for t in texts if number(t)))

    pos, unl = sample(lambda i: learned.get(i) == 1), sample(lambda i: not out(i))
    known = []
    for w in sorted(set().union(*pos, *unl)):
        n, m = sum(w in x for x in pos), sum(w in x for x in unl)
        p = (n + m) / (len(pos) + len(unl))
        spread = math.sqrt(p * (1 - p) * (1 / len(pos) + 1 / len(unl))) + 1e-12
        if n + m >= toxicity.LEAST_TEXTS and abs(n / len(pos) - m / len(unl)) / spread >= toxicity.DEVIATIONS:
            known.append(w)
    dense = lambda sets: np.array([[float(w in x) for w in known] for x in sets])
    x, fits = dense(pos), []
    for k in range(toxicity.MODELS):
        y = dense(unl)[k % 2 :: 2]
        w, b = np.random.default_rng(k).normal(0, 0.01, len(known)), math.log(prior / (1 - prior))
        step = 1 / (0.25 * (2 * prior * (1 + x.sum() / len(x)) + 1 + y.sum() / len(y)))
        old, old_b, t = w, b, 1.0
        for _ in range(toxicity.ROUNDS):
            p, u = 1 / (1 + np.exp(-(x @ w + b))), 1 / (1 + np.exp(-(y @ w + b)))
            if np.mean(-np.log(1 - u)) - prior * np.mean(-np.log(1 - p)) >= 0:
                # d/dg of prior * -log(p) + mean(-log(1 - u)) - prior * -log(1 - p)
                gp, gu = prior * (p - 1) / len(x) - prior * p / len(x), u / len(y)
            else:
                gp, gu = prior * p / len(x), -u / len(y)
            new, new_b = w - step * (x.T @ gp + y.T @ gu), b - step * (gp.sum() + gu.sum())
            new = np.where(np.abs(new) > step * toxicity.LASSO, new - np.sign(new) * step * toxicity.LASSO, 0)
            later = (1 + math.sqrt(1 + 4 * t * t)) / 2
            w, b = new + (t - 1) / later * (new - old), new_b + (t - 1) / later * (new_b - old_b)
            old, old_b, t = new, new_b, later
        fits.append((old, old_b))
    weight, bias = dict(zip(known, np.mean([w for w, _ in fits], axis=0), strict=True)), np.mean([b for _, b in fits])
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, folder).collect()}
    assert len(got) == len(rows) and len(known) > 3
    for r in rows:
        words = {w for w in phrase_index.words_of((r.text or "").encode())}
        score = 1 / (1 + math.exp(-(sum(weight.get(zlib.crc32(w) % toxicity.SPACE, 0.0) for w in words) + bias)))
        g = got[r.doc_id]
        assert g.held_out == out(r.doc_id) and g.score == pytest.approx(score, abs=1e-6) and g.predicted == (g.score >= 0.5)


def test_toxicity_samples_by_features(spark, monkeypatch):
    """The samples' features are bounded, however long the texts: the first by hash that fit are taken."""
    rows = [(" ".join(f"w{k}x{j}" for j in range(10 + k)),) for k in range(20)]
    df = spark.createDataFrame(rows, "text string").select(F.lit(1).alias("doc_id"), F.col("text").cast("binary").alias("text")).repartition(3)
    whole = toxicity._sample(df.select("doc_id", "text"), 100)
    assert sorted(map(len, whole)) == list(range(10, 30))
    for most in (9, 60, 200):
        monkeypatch.setattr(toxicity, "MOST_FEATURES", most)
        some = toxicity._sample(df, 100)
        total = np.cumsum([len(x) for x in whole])
        assert [x.tolist() for x in some] == [x.tolist() for x in whole[: int((total <= most).sum())]]
    assert len(toxicity._sample(df, 3)) <= 3
