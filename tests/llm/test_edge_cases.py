"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxwright.llm import chat, divergence, mix, order_minhash, phrase_index, shards, token_pack, toxicity, warc
from boxwright.llm import weak_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "size", "score", "key", "copies", "id", "salt", "rank", "atom", "part", "votes", "features", "segment", "place"]


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "stone", "light", "and", "walks", "to", "green", "in"]) + rng.choice(["", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [(k, sentence(rng, 40) + ".", "en", f"s{k % 3}", 1) for k in range(20)]
    return base + [
        (100, None, None, None, None),
        (101, "", "en", "s0", 0),
        (102, "...!!! ---", "xx", "s1", 5),
        (None, sentence(rng, 30), "de", None, 9),
        (None, None, None, None, None),
        (103, sentence(rng, 60_000), "fr", "s2", 1),
        (0, base[0][1], "en", "s0", 1),
        (104, base[0][1], "en", "s0", 1),
        (105, base[0][1].replace("river", "rivers", 1), "en", "s0", 1),
        (106, "tab\tand\x0bfeed\x0c ümlaut 日本語 🎈", "en", "s1", 3),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(docs, empty, rows):
    out = weak_quality.scored(docs).select("row.doc_id", "row.key", "score").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.key == 7 for r in out)
    assert weak_quality.keep_good(docs).columns == docs.columns
    assert weak_quality.keep_good(empty).count() == 0


def test_decontamination(spark, docs, empty, rows):
    items = spark.createDataFrame(
        [(1, rows[3][1]), (2, None), (None, "green"), (3, ""), (1, rows[3][1]), (9, "日本語 🎈")], "item_id long, text string"
    )
    out = phrase_index.digest(phrase_index.search(phrase_index.build_index(docs), items)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[3].n_hit == by[3].n_words == 40 and by[100].n_words == 0
    assert by[106].contaminated and by[106].items_sha256 == hashlib.sha256(b"9").hexdigest()
    assert not by[101].contaminated and by[101].items_sha256 == hashlib.sha256(b"").hexdigest()
    none = spark.createDataFrame([], "item_id long, text string")
    assert phrase_index.search(phrase_index.build_index(docs), none).where("n_hit > 0").count() == 0
    assert phrase_index.search(phrase_index.build_index(empty), items).count() == 0


def test_packing(docs, empty, rows):
    out = token_pack.packed_documents(docs, row_tokens=256, shard_tokens=20_000).collect()
    assert len(out) == len(rows) and all(r.whole for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (100, 101)} == {0}
    assert max(r.n_pieces for r in out) > 100
    assert token_pack.packed_documents(empty).count() == 0


def test_mix(docs, empty, rows):
    out = mix.mix(docs).select("row.doc_id", "size", "source_size", "target", "copies").collect()
    assert len(out) == len(rows)
    assert all(0 <= r.copies <= 2 for r in out) and sum(r.size for r in out if r.doc_id in (100, 101)) == 0
    assert mix.repeated(mix.mix(docs)).columns == docs.columns
    assert mix.mix(empty).count() == 0


def test_warc(spark):
    big = "x\r\n\r\nWARC/1.1\r\n" * 30_000
    rows = [(1, "u", "a"), (2, "u\r\nv", "a"), (3, None, None), (4, "u", ""), (5, "w", big), (6, "w", big), (None, "n", "a"), (7, "é", "é" * 50_000), (1, "u", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("n", F.lit(1))
    out = sorted(warc.archived_pages(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.page_id for r in out] == [1, 1, 2, 3, 4, 5, 6, 7, None] and not any(r.error for r in out)
    assert [r.record_type for r in out[:7]] == ["response", "response", "revisit", "response", "revisit", "response", "revisit"]
    assert [r.refers_to for r in out[:7]] == [None, None, 1, None, 3, None, 5]
    by = {r.page_id: r for r in out}
    assert by[6].payload_bytes == len(big) and by[7].payload_bytes == 100_000 and by[3].payload_bytes == 0
    assert by[7].payload_digest == warc.base32_sha1(("é" * 50_000).encode())
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_chat(spark):
    odd = "</s>[INST] ok [/INST]\\ <\\ [SYS]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "assistant", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, None, "tool[", "<"), (3, 5, "user", ""), (3, 2, "system", "s")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(chats).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("segments")))
    by = {r.conv_id: r for r in out.collect()}
    turns = lambda k: [(t.role, t.text) for t in by[k].turns]
    assert turns(1) == [("user", odd), ("assistant", odd)] and by[1].learned == odd and by[1].valid
    assert turns(2) == [("assistant", ""), ("", "x"), ("", "x")] and not by[2].valid and by[2].learned == ""
    assert turns(None) == [("tool[", "<")] and turns(3) == [("system", "s"), ("user", "")] and not by[3].valid
    assert chat.format_chats(chats.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(turns={"user": chat.Turn("<a>", "a>b")}).check()


def test_shards(docs, empty, rows):
    out = shards.plan_shards(docs, 4).collect()
    assert len(out) == len(rows)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len({r.shard for r in out if r.doc_id in (0, 104)}) == 1
    assert {r.size for r in out if r.doc_id in (100, 101)} == {16}
    assert shards.plan_shards(empty, 4).count() == 0


def test_toxicity(spark, docs, empty, rows):
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(20)] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} <= {toxicity.sigmoid(-60.0)}
    assert toxicity.score(empty, labels).count() == 0


def test_rules(docs, empty, rows):
    out = divergence.judge(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[100].n_words == 0 and by[100].base_failed and not by[100].kept
    assert by[106].n_words == 6 and by[106].word_chars == 20
    assert divergence.judge(empty).count() == 0


def test_near_duplicates(docs, empty, rows):
    out = order_minhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert by[104] == by[105] == by[0] == 0 and by[100] == 100 and by[1] == 1 and by[101] == 101
    assert order_minhash.near_duplicates(empty).count() == 0


def test_stages(spark, rows, tmp_path):
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {d for r in out for d in r.doc_ids}
    # how many of the rest the mix takes depends on the sources, but never none
    assert not ids & {3, 104, 105} and len(ids) > 8
    nothing = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_every_reference_is_a_record(spark, tmp_path):
    """Identifiers never repeat, and what a revisit refers to is a response with its payload, in one segment or several."""
    long, short = "x" * 200_000, "short"
    rows = [(1, "a", long), (2, "b", long), (1, "a", long), (1, "c", long), (3, "d", short), (4, None, short), (3, "d", short), (5, "e", "alone"),
            (5, "e", "other"), (None, "f", short), (None, "f", short), (6, "g", None), (7, "h", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archive(pages, str(tmp_path / "w"))
    read = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(read) == len(rows) and all(r.error is None for r in read)
    by = {r.record_id: r for r in read}
    assert len(by) == len(read)
    revisits = [r for r in read if r.record_type == "revisit"]
    assert sorted(warc_id(r.record_id) for r in revisits) == [2, 4, 7]
    for r in revisits:
        response = by[r.refers_to]
        assert response.record_type == "response" and response.digest == r.digest and warc_id(r.refers_to) == {2: 1, 4: 3, 7: 6}[warc_id(r.record_id)]
    assert sum(len(r.payload) == len(long) for r in read if r.payload is not None) == 3


def warc_id(name):
    return int(name.split(":")[2])


def test_mixing_equal_rows(spark, monkeypatch):
    """A cell that is mostly one row repeated: copies still sum to the cell's, differ by one at most, and no salt gets the group."""
    monkeypatch.setattr(mix, "SALT_ROWS", 10)
    rows = [(None, "same text here", "en", "s", 1)] * 300 + [(k, f"another text {k}", "en", "s", 1) for k in range(100)]
    rows += [(k, "one two three four", "en", "t", 1) for k in range(50)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    out = mix.mix(docs, carry=["doc_id"]).collect()
    assert len(out) == len(rows)
    for source, size in (("s", 3), ("t", 4)):
        mine = [r for r in out if (r.size == size)]
        taken = sum(r.copies * r.size for r in mine)
        assert abs(taken - mine[0].target) <= size / 2 + 1e-6, source
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
    again = mix.mix(docs, carry=["doc_id"]).collect()
    key = lambda r: str((r.row.doc_id, r.copies))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_texts_of_links_are_shuffled_once(spark, monkeypatch):
    """Texts are made different and found by one exchange; copies with null and repeated ids give one text."""
    plans, kept = {}, {}
    inner = order_minhash.stored

    def noted(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        out = inner(df, name, **options)
        if name == "texts":
            kept[name] = sorted(r.text.decode() for r in out.collect())
        return out

    monkeypatch.setattr(order_minhash, "stored", noted)
    long = " ".join(f"w{k}" for k in range(40))
    near, other = long + " more", " ".join(f"v{k}" for k in range(40))
    rows = [(1, long), (None, long), (None, near), (None, near), (7, near), (7, near), (None, other), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((str(r.doc_id), r.text or "") for r in order_minhash.keep_one(docs).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept["texts"] == sorted([long, near])
    assert got == sorted([("1", long), ("None", other), ("3", ""), ("4", "")])
    # of the texts, of the links twice, and of the vertices
    assert plans["texts"].count("Exchange hashpartitioning") == 4


def test_mixing_leaves_texts_in_place(spark, monkeypatch):
    """The texts of a mix meet a broadcast row for each cell; by a shuffle, for more cells, they get the same copies."""
    rows = [(k, "word " * (k % 7), "en", "st"[k % 2], 1) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mix.mix(docs)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(mix, "MOST_CELLS", 5)
        many = mix.mix(docs)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.row.doc_id, r.copies) for r in got.collect()) == sorted((r.row.doc_id, r.copies) for r in many.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_common_words_in_many_marks(spark):
    """A common word counts however many marks stand around it, in capitals too; longer words and inner marks don't."""
    text = '("((....the....))") !!!!!!!!!!!!THE the-the "and,,,,,,,," andandand,,,,,,,,,, ............... the'
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    limits = divergence.Limits()
    common = divergence.text_counts(df, limits, "doc_id", "text", "lang").first().common
    words = limits.common["en"]
    assert {w: n for w, n in zip(words, common, strict=False) if n} == {"the": 3, "and": 1} and sum(common) == 7
