"""Prefix trie, conversation repair and SimHash components against brute force, in one partition and in many."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boxwright.llm import prefix_trie, queries, repair, simhash

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CHAT = "conv_id long, turn long, role string, text string"
CLASH = ("id", "words", "key", "ref", "part", "n", "kind", "place", "same", "print", "tile", "parts", "group", "least", "t", "base", "h")


@pytest.fixture(params=[False, True], ids=["coalesced", "partitions"])
def dealt(spark, request):
    """Once as it comes, and once over more partitions than rows can fill evenly."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    if request.param:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def chats(spark, rows):
    return spark.createDataFrame(rows, CHAT).withColumns({c: F.lit(3) for c in CLASH}).repartition(3)


@needs_tables
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_repair"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    out = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    place = [[c[0] for c in found.description].index(c) for c in out.columns]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(tuple(r[k] for k in place)) for r in found.fetchall())


# -- prefix trie


def plain_trie(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = convs.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = lambda p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        out.append(
            (
                min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children(path)),
                sum(not children(p) for p in below), sum((len(nodes[p]) - 1) * words(p) for p in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(map(str, out))


def found_trie(df):
    return sorted(str(tuple(r)) for r in prefix_trie.trie(prefix_trie.grafted(prefix_trie.turn_lists(df))).collect())


def some_chats(rng, n, deep=5):
    """Conversations of few different turns, so that prefixes are shared."""
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, deep)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "d  e\tf"])))
    return rows


def test_trie(spark, dealt):
    rows = some_chats(random.Random(5), 90)
    rows += [(200, t, "user", "a b") for t in range(60)]  # one long conversation
    rows += [(c, 0, "user", "same") for c in range(301, 380)]  # a large group of equal ones
    rows += [(c, t, None if t else "user", None) for c in (-7, -40, 400) for t in range(3)]
    rows += [(401, None, "user", "x"), (401, 4, "user", "y"), (401, None, "user", "x"), (None, 0, "user", "lost"), (402, None, None, None)]
    rows += rows[5:9]
    assert found_trie(chats(spark, rows)) == plain_trie(rows)


def test_trie_of_wide_nodes(spark, dealt, monkeypatch):
    """More children than wait for their parent's name, and ends in several rows."""
    monkeypatch.setattr(prefix_trie, "WAITING", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rng = random.Random(6)
    rows = [(c, 0, "system", "one") for c in range(120)] + [(c, 1, "user", f"t{rng.randrange(60)}") for c in range(0, 120, 2)]
    rows += [(c, 2, "assistant", f"u{c % 7} v") for c in range(0, 120, 4)]
    assert found_trie(chats(spark, rows)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert found_trie(chats(spark, [])) == []
    assert found_trie(chats(spark, [(None, 1, "user", "a")])) == []


# -- repair


def plain_repair(rows):
    """By audits kept as strings: the cheapest for each state, turn by turn."""
    text = lambda x: " " if x is None else str(x)
    convs = {r[0]: [] for r in rows}
    for c, turn, role, said in rows:
        fault = zlib.crc32(f"{text(c)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = "" if fault == 1 else re.sub("[.!?]", "", said) if fault == 2 else said
        convs[c] += [(turn, "user" if fault == 4 else role, said)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    given = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{'' if c is None else c}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, kinds = set(), []
        for _, role, said in turns:
            rest = said.rstrip(" \t\n\x0b\x0c\r")
            kinds.append("b" if not rest else "d" if (role, said) in seen else "" if rest[-1] in ".!?" else "t")
            seen.add((role, said))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))

        def inserted(states, given=given):
            best = dict(states)
            for _ in range(2):
                for q, (cost, audit, said) in list(best.items()):
                    role, to = given[q]
                    found = (cost + 2, audit + "I", (*said, f"{role}:"))
                    best[to] = min(best.get(to, found), found)
            return best

        states = {"": (0, "", ())}
        for (_, role, said), kind in zip(turns, kinds, strict=True):
            best = {}
            # ties between runs of inserts: all are tried, as one that costs the same may come first with what follows
            for q0, (c0, a0, s0) in states.items():
                runs = [(q0, c0, a0, s0)]
                for _ in range(2):
                    q, cost, audit, texts = runs[-1]
                    runs.append((given[q][1], cost + 2, audit + "I", (*texts, f"{given[q][0]}:")))
                for q, cost, audit, texts in runs:
                    options = [(q, 3, "D", ())]
                    if kind not in ("b", "d"):
                        cut = int(kind == "t")
                        options.append((given[q][1], 2 + cut, "R", (f"{given[q][0]}:{said}",)))
                        if q + role[:1] in ("s", "u", "su", "ua", "au") and role[:1]:
                            options.append((role[:1], cut, "K", (f"{role}:{said}",)))
                    for to, more, edit, texts_more in options:
                        found = (cost + more, audit + edit, texts + texts_more)
                        best[to] = min(best.get(to, found), found)
            states = best
        ends = inserted(states)
        cost, audit, texts = min(ends[q] for q in ("", "a") if q in ends)
        digest = hashlib.sha256("\n".join(texts).encode()).hexdigest()
        out.append((c, gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, digest))
    return sorted(map(str, out))


def found_repair(df):
    return sorted(str(tuple(r)) for r in repair.repaired(repair.damaged(df)).collect())


@pytest.mark.parametrize("piece", [1 << 16, 5])
def test_repair(spark, dealt, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = random.Random(8)
    texts = ["Yes.", "No", "Well?\n", "", None, " \t", "a.b", "Ä!", "so"]
    rows = []
    for c in [*range(60), None, -5]:
        for t in range(rng.randrange(1, 10)):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"]), rng.choice(texts)))
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(150)]  # a long conversation
    rows += [(901, 0, "user", "again.")] * 30
    rows += [(902, 2**62, "user", "far."), (902, -(2**62), "assistant", "apart.")]
    assert found_repair(chats(spark, rows)) == plain_repair(rows)


def test_repair_of_nothing(spark):
    assert found_repair(chats(spark, [])) == []
    # all turns are dropped
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found_repair(chats(spark, [(lost, 0, "user", "x")])) == [str((lost, 0, 0, 0, 0, 0, 0, "", empty))]


def test_cheapest_of_all_edits():
    """Every edit of up to three turns with up to two inserts in each gap, against the layers."""
    rng = random.Random(9)
    runs = [x for k in range(3) for x in itertools.product("ua", repeat=k)]
    for _ in range(12):
        turns = [(rng.choice("uas?"), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(1, 4))]
        best = None
        options = []
        for initial, fault in turns:
            of = [("D", "", 3)]
            if fault != 2:
                of += [("K", initial, int(fault == 1)), ("R", "u", 2 + (fault == 1)), ("R", "a", 2 + (fault == 1))]
            options.append(of)
        for gaps in itertools.product(runs, repeat=len(turns) + 1):
            for edits in itertools.product(*options):
                roles = "".join("".join(g) + e[1] for g, e in zip(gaps, edits, strict=False)) + "".join(gaps[-1])
                if re.fullmatch("(s?(ua)+)?", roles):
                    audit = "".join("I" * len(g) + e[0] for g, e in zip(gaps, edits, strict=False)) + "I" * len(gaps[-1])
                    cost = sum(e[2] for e in edits) + 2 * sum(map(len, gaps))
                    best = min(best or (cost, audit), (cost, audit))
        piece = repair._Piece()
        piece.turns = [(i, f, i, b"") for i, f in turns]
        layer, pointers = piece.walk(0)
        cost, state = repair._ended(layer)
        writer = repair._Writer()
        writer.piece(piece, pointers, state)
        assert (cost, writer.end()[0]) == best


# -- SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(prints))]


def test_simhash_of_odd_texts(spark, dealt):
    rng = random.Random(10)
    words = ["the", "River", "stone", "LIGHT", "ümlaut", "日本", "a b"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 50, 50, 400, 40_000)]
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:5], None, "", " \t\n", texts[6].replace("the", "THE"), texts[7] + " end"])]
    rows += [(None, texts[0]), (None, None), (None, "alone here"), (3, texts[3]), (3, "other row of that id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    want = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if roots[x] == roots[k] and rows[x][0] is not None]
        want.append(str((doc, f"{prints[k]:016x}", min(ids, default=None))))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == sorted(want)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("homes", "side"), [(1 << 16, 1024), (13, 4)])
def test_no_link_is_lost(spark, dealt, monkeypatch, homes, side):
    """Fingerprints in chains, dense groups, and pairs that differ in 3 and 4 bits, near the ends of the tiles too."""
    monkeypatch.setattr(simhash, "MOST_HOMES", homes)
    monkeypatch.setattr(simhash, "SIDE", side)
    rng = random.Random(11)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {0, (1 << 64) - 1, 7, 15, (1 << 63) | 3}
    for _ in range(120):
        x = rng.getrandbits(64)
        prints |= {x, flip(x, rng.randrange(1, 5))}
    x = rng.getrandbits(64)
    for _ in range(40):  # a chain
        x = flip(x, 3)
        prints.add(x)
    x = rng.getrandbits(64)
    prints |= {flip(x, rng.randrange(0, 3)) for _ in range(150)}  # a dense group
    rows = sorted(prints)
    signed = np.array(rows, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "print long")).collect()
    back = dict(zip(signed, range(len(rows)), strict=True))
    assert all(bin(rows[back[a]] ^ rows[back[b]]).count("1") <= 3 for a, b in found)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = root(back[a]), root(back[b])
        parent[max(x, y)] = min(x, y)
    assert [root(k) for k in range(len(rows))] == plain_components(rows)
