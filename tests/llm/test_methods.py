"""The methods against plain versions of themselves."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from boxwright.llm import mix, order_minhash, phrase_index, queries, shards, token_pack, toxicity, warc, weak_quality

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_alignment():
    rng = random.Random(3)
    with np.errstate(over="ignore"):
        for _ in range(600):
            v = rng.choice([2, 3, 8, 50])
            a = [rng.randrange(v) for _ in range(rng.randint(1, 25))]
            b = list(a) if rng.random() < 0.7 else [rng.randrange(v) for _ in range(rng.randint(1, 25))]
            for _ in range(rng.randint(0, 5)):
                k, op = rng.randrange(len(b) + 1), rng.random()
                if op < 0.3 and len(b) > 1:
                    b.pop(min(k, len(b) - 1))
                elif op < 0.6:
                    b.insert(k, rng.randrange(v))
            most = rng.randint(0, 12)
            got = order_minhash.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
            assert got == min(edit_distance(a, b), most + 1)
            short, long_ = sorted((a, b), key=len)
            assert order_minhash.banded_distance(short, long_, most) == got
            assert order_minhash.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most, got) == got


def test_search_of_a_bucket_leaves_out_no_similar_pair():
    rng = random.Random(13)
    for _ in range(40):
        texts = []
        for _ in range(25):
            a = [rng.randrange(12) for _ in range(rng.randint(1, 30))]
            texts.append(a)
            b = list(a)
            for _ in range(rng.randint(0, 1 + len(a) // 5)):
                k, op = rng.randrange(len(b) + 1), rng.random()
                b[k : k + (op < 0.6)] = [] if op < 0.3 else [rng.randrange(12)]
            texts.append(b)
        own = np.array([rng.randrange(40) for _ in texts])
        made = [np.array(t, np.uint32) for t in texts]
        one, other, shared = order_minhash.close_pairs(made, own, lambda x, y: np.ones(len(x), bool))
        found = set(zip(one.tolist(), other.tolist(), strict=True))
        for x in range(len(texts)):
            for y in range(x + 1, len(texts)):
                longer = max(len(texts[x]), len(texts[y]))
                if own[x] != own[y] and longer > 1 and edit_distance(texts[x], texts[y]) <= order_minhash.allowed(longer, longer):
                    assert (x, y) in found, (texts[x], texts[y])
        for x, y, n in zip(one.tolist(), other.tolist(), shared.tolist(), strict=True):
            both = collections.Counter(texts[x]) & collections.Counter(texts[y])
            assert n == both.total()


def test_short_texts_meet():
    rng = random.Random(14)
    with np.errstate(over="ignore"):
        for _ in range(300):
            a = [rng.randrange(1 << 40) for _ in range(rng.randint(1, order_minhash.SHORT))]
            b = list(a)
            for _ in range(rng.randint(0, 2)):
                k, op = rng.randrange(len(b) + 1), rng.random()
                b[k : k + (op < 0.6)] = [] if op < 0.3 else [rng.randrange(1 << 40)]
            x, y = (np.array(t, np.uint64) for t in (a, b))
            if 0 < len(b) <= order_minhash.SHORT and order_minhash.similar(x, y):
                assert set(order_minhash.remainders(x).tolist()) & set(order_minhash.remainders(y).tolist())


def test_order_matters_to_sketches():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        a = rng.integers(0, 1 << 60, 300).astype(np.uint64)
        near, moved = a.copy(), np.concatenate([a[150:], a[:150]])
        near[17] = 5
        agree = lambda x: (order_minhash.sketch(a) == order_minhash.sketch(x)).sum()
        assert agree(near) > 30 and agree(moved) < 0.75 * agree(near)


def least_capacity(sizes, n):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(n):
        new = [0] + [float("inf")] * len(sizes)
        for j in range(1, len(sizes) + 1):
            new[j] = min(max(best[i], sum(sizes[i:j])) for i in range(j + 1))
        best = new
    return best[-1]


def test_smallest_capacity():
    rng = random.Random(5)
    for _ in range(150):
        sizes, n = [rng.randint(1, 30) for _ in range(rng.randint(1, 12))], rng.randint(1, 6)
        capacity = shards.smallest_capacity(sizes, n)
        assert capacity == least_capacity(sizes, n)
        where = shards.cut(sizes, n)
        loads = collections.Counter()
        for s, w in zip(sizes, where, strict=True):
            loads[w] += s
        assert where == sorted(where) and max(where) < n and max(loads.values()) <= capacity


def test_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        rows = token_pack.best_fit_decreasing(lengths, capacity)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in r) <= capacity for r in rows)
        room = []  # the same by looking at all rows
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [x for x in room if x >= lengths[k]]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else capacity) - lengths[k])
        assert sorted(room) == sorted(capacity - sum(lengths[k] for k in r) for r in rows)


def test_tokens_are_the_tokenisers():
    pa = pytest.importorskip("pyarrow")
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    import base64

    texts = ["", " ", "a  b", "Hello, world! it's", "x\n\n y", "tail ", " lead", "日本語 text　wide", "a b c", "1 22  333", "end\n"]
    encode, width = token_pack.tokenizer("byte_bpe_50k.tiktoken", None)
    data, at = encode(pa.array(texts))
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, t in enumerate(texts):
        assert np.frombuffer(data[at[k] : at[k + 1]], np.uint16).tolist() == plain.encode_ordinary(t), t


def test_targets():
    assert mix.targets({"a": 100, "b": 10, None: 50}) == {"b": 20.0, "a": 132.0, None: 88.0}
    assert mix.targets({}) == {} and sum(mix.targets({"a": 5, "b": 0}).values()) == 7.5


def test_framing_and_damage():
    for payload in (b"", b"x", b"0\r\n\r\n" * 5000):
        assert warc.dechunked(warc.chunked(payload)) == payload
    for bad in (b"", b"5\r\nab", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_damaged_segments_are_reported(spark, tmp_path):
    whole = [*warc.page_records(1, "u", b"p" * 300, None, 100)]
    lost = [x for k, x in enumerate(warc.page_records(2, "u", b"q" * 300, None, 100)) if k != 1]
    random.Random(1).shuffle(whole)
    (tmp_path / "a").mkdir()
    import gzip

    (tmp_path / "a" / "x.gz").write_bytes(gzip.compress(b"".join(r + warc.SEPARATOR for r in whole + lost)))
    (tmp_path / "a" / "y.gz").write_bytes(gzip.compress(b"no archive"))
    out = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert [bytes(r.payload) for r in out if r.payload is not None] == [b"p" * 300]
    assert sorted(r.error for r in out if r.error) == ["damaged file: no record at byte 0", "segments are missing or repeated"]


def test_proximity():
    rng, words = random.Random(9), [b"a", b"b", b"c", b"d", b"e"]
    text = [rng.choice(words) for _ in range(400)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b" ".join(text[:200]), b" ".join(text[200:])])], names=["d", "t"])
    (segment,) = phrase_index._segments(iter([batch]))
    s = phrase_index.Segment(segment.to_pylist()[0])
    windows = [(b"a", b"b", b"c"), (b"e", b"d"), (b"a", b"a"), (b"q", b"a")]
    which, start, end = s.near(phrase_index.Windows(windows), 1)
    want = set()
    for w, window in enumerate(windows):
        for doc in (range(200), range(200, 400)):
            for i in doc:
                if text[i] not in window:
                    continue
                for j in range(i + 1, min(i + len(window) + 1, doc.stop) + 1):
                    if set(window) <= set(text[i:j]):
                        want.add((w, i, j))
                        break
    assert set(zip(which.tolist(), start.tolist(), end.tolist(), strict=True)) == want


@pytest.mark.parametrize("block", [1 << 19, 50, 9])
def test_search_against_all_stretches(spark, monkeypatch, block):
    """Exact and proximity matches against every stretch of every text; items in one block, in several, in pieces."""
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", block)
    rng = random.Random(10)
    text = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(k, text(rng.choice([0, 3, 10, 25]), 9 if k % 2 else 300)) for k in range(12)]
    docs = [(k, text(rng.randint(0, 60), 9)) for k in range(30)]
    for k in range(30, 50):  # texts that hold an item, or its words with others between them and two of them swapped
        w = rng.choice([i for _, i in items if i]).split()
        if k % 2:
            a = rng.randrange(len(w))
            w = [*w[:a], "between", *w[a:]]
            w[:2] = w[1::-1]
        docs.append((k, f"{text(5, 50)} {' '.join(w)} {text(5, 50)}"))
    want = {}
    for k, t in docs:
        w, hit, near, found, found_near = t.split(), set(), set(), set(), set()
        for i, item in items:
            for x in phrase_index.windows_of(item.split()):
                n = len(x)
                for a in range(len(w)):
                    if tuple(w[a : a + n]) == x:
                        hit.update(range(a, a + n))
                        found.add(str(i))
                    if w[a] in x:
                        for b in range(a + 1, min(a + n + 2, len(w)) + 1):
                            if set(x) <= set(w[a:b]):
                                near.update(range(a, b))
                                found_near.add(str(i))
                                break
        want[k] = (len(w), len(hit), sorted(found), len(near), sorted(found_near))
    schema = "doc_id long, text string"
    index = phrase_index.build_index(spark.createDataFrame(docs, schema).repartition(3))
    got = phrase_index.search(index, spark.createDataFrame(items, schema.replace("doc", "item")), 2).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items, r.n_near, r.near_items) for r in got} == want
    assert all(sum(x.length for x in r.spans) == r.n_hit for r in got) and any(v[3] > v[1] for v in want.values())


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    votes = np.full((20_000, len(weak_quality.LABELLERS)), 3)
    for k in range(len(weak_quality.LABELLERS)):
        right = np.where(good, 2, 1)
        wrong = np.where(good, 1, 2)
        votes[:, k] = np.where(rng.random(20_000) < 0.3, 0, np.where(rng.random(20_000) < 0.85, right, wrong))
    model = weak_quality.LabelModel(collections.Counter(bytes(v.tolist()) for v in votes))
    found = np.array([model.posterior(bytes(v.tolist())) > 0.5 for v in votes[:3000]])
    assert (found == good[:3000]).mean() > 0.95 and abs(model.good - 0.8) < 0.05
    assert all(0.75 < a < 0.95 for a in model.accuracies().values())


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(3)
    text = lambda toxic: np.unique(np.concatenate([rng.integers(0, 500, 40), 1000 + rng.integers(0, 5, 3) if toxic else []]).astype(np.int32))
    unlabelled = [text(rng.random() < 0.15) for _ in range(3000)]
    used, w, b = toxicity.fit([text(True) for _ in range(600)], unlabelled, 0.15)
    of = dict(zip(used.tolist(), w.tolist(), strict=True))
    score = lambda x: sum(of.get(int(k), 0.0) for k in x) + b
    assert np.mean([score(text(True)) > 0 for _ in range(300)]) > 0.9
    assert np.mean([score(text(False)) < 0 for _ in range(300)]) > 0.97
    assert toxicity.fit([], unlabelled, 0.1)[2] < 0


@needs_tables
def test_decontamination_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pattern.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for r in items:
        w = words(r.text)
        for a in range(max(1, len(w) - 9)):
            windows[tuple(w[a : a + 10])].add(r.item_id)
    got = {r.doc_id: r for r in queries.op2_decontaminate(spark, SF).collect()}
    for r in docs:
        w = words(r.text)
        hit, found = set(), set()
        for a in range(len(w) - 9):
            if tuple(w[a : a + 10]) in windows:
                hit.update(range(a, a + 10))
                found |= windows[tuple(w[a : a + 10])]
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items) == (len(w), len(hit), len(found))
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@needs_tables
def test_rules_query(spark):
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, SF).collect()}
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = pattern.findall(r.text)
        often = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        under = {k for j in range(len(w) - 4) if often[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in r.text.split("\n") if pattern.search(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_repeat_words) == (len(w), sum(map(len, w)), len(under))
        assert (g.n_symbols, g.n_dup_lines) == (sum(r.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert g.base_failed == (len(w) < 10 or 100 * len(under) > 20 * len(w)) and not (g.kept and g.base_failed)


@needs_tables
def test_mix_query(spark):
    rows = queries.op4_mix(spark, SF).collect()
    taken, target, top = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r.taken <= 2 * r.size
        k = (r.source_size, r.target)
        taken[k] += r.taken
        target[k] = r.target
        top[k] = max(top[k], r.size)
    assert all(abs(taken[k] - target[k]) <= top[k] for k in target)
    again = queries.op4_mix(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


@needs_tables
def test_shards_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    loads, by_text, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in queries.op7_shards(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 40
        loads[r.shard] += r.size
        by_text[raw].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@needs_tables
def test_chat_query(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op6_chat"]).fetchall()
    assert sorted(map(tuple, queries.op6_chat(spark, SF).collect())) == sorted(want)


@needs_tables
def test_packing_query(spark):
    rows = queries.op3_pack(spark, SF).collect()
    encode, _ = token_pack.tokenizer("byte_bpe_50k.tiktoken", None)
    import pyarrow as pa

    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        data, _ = encode(pa.array([r.text]))
        (got,) = [x for x in rows if x.doc_id == r.doc_id]
        assert got.whole and got.ids_sha256 == hashlib.sha256(data).hexdigest()


@needs_tables
def test_near_duplicates_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {r.doc_id: phrase_index.words_of(r.text.encode()) for r in rows}
    got = {r.doc_id: r.class_id for r in queries.op10_near_duplicates(spark, SF).collect()}
    ids = sorted(words)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = words[a], words[b]
            if min(len(x), len(y)) < 40 or abs(len(x) - len(y)) > 0.2 * max(len(x), len(y)):
                continue
            shared = len(set(zip(x, x[1:], x[2:], strict=False)) & set(zip(y, y[1:], y[2:], strict=False)))
            if shared > 0.4 * len(x):
                most = order_minhash.allowed(len(x), len(y))
                if max(len(x), len(y)) < 800 and edit_distance(x, y) <= 0.9 * most:
                    assert got[a] == got[b], (a, b)
