"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of K words (all words, if it has fewer), each labelled with how often it occurred
before. Each of FUNCTIONS hash functions takes the two k-mers with the smallest hashes and keeps them in the order of
the text; so two texts agree in a function with a probability that falls with their edit distance, and moved text
counts as different. Classes are made in five steps.

1. Equal texts are one vertex, known by 16 bytes of MD5.
2. In each function, texts with the same pair meet in a bucket; each is linked to the bucket's centre, the member with
   the smallest key, which partial aggregation finds without gathering a bucket anywhere. Texts of up to SHORT words,
   of which a change may leave no k-mer, also meet under what is left of them without as many words as may differ, so
   that no similar pair of short texts is missed.
3. Each text's best link is verified by edit distance of words, aligned only within the band that SIMILARITY allows.
   A large group of copies costs about one alignment a text.
4. A bucket that then still holds several classes is searched for all its pairs of different classes, as neither of
   two similar texts need be its centre: an index of the rarest word pairs of its texts and a count of shared words
   leave out only pairs that can't be similar. The search is split by length, and into pairs of parts of at most PART
   texts and PART_WORDS words; the pairs left are aligned in place, by 32-bit word hashes, until their classes are linked.
   Links found there, and those of buckets of two texts, are verified with whole words: first the best of each two
   classes, then all others whose classes still differ. Links within a class need no verification; no pair that meets in
   a bucket is passed over.
5. Classes are the connected components of verified links, by label propagation with tables in the shared folder.

SIMILARITY is 1 - distance / words of the longer text. Words are lower-cased runs of letters and digits. Texts without
words are only equal to equal texts; a null text is in a class of its own row. A class is named by its smallest doc_id;
null doc_ids count in no class's name. Repeated rows are rows of one class. An empty table gives an empty result; other
columns are ignored, whatever their names. Whole texts are aligned, however long they are: time grows with length times
allowed distance. Pairs that meet in no bucket are not found; README.md has the share of pairs that meet, by similarity
and length. A bucket of n texts that stays mixed costs about n * n / PART rows of the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import drop_stored, stored, text_key, words_of

#: With k-mers of three words, scattered changes down to SIMILARITY leave enough of them for nearly all pairs to meet.
K = 3
FUNCTIONS = 40
SIMILARITY = 0.8
#: Texts of so many words or fewer also meet by what is left of them without some words.
SHORT = 14
#: Edits up to which an alignment follows furthest-reaching paths.
FEW = 10
#: Texts and words of one part of a bucket that is searched; two parts meet in a task.
PART = 1500
PART_WORDS = 1_500_000

_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)[:, None]
_ODD = (_rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_PLACE = (_rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_LABEL = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of K words, labelled with the number of equal runs before."""
    n = max(1, len(words) - K + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(K, len(words))):
        h += words[j : j + n] * np.uint64(_PLACE[j])
    h = mixed(h)
    labels = np.zeros(n, np.uint64)
    ordered = np.argsort(h, kind="stable")
    same = h[ordered][1:] == h[ordered][:-1]
    if same.any():
        place = np.arange(n)
        labels[ordered] = place - np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))
    return mixed(h + labels * _LABEL)


def sketch(words: np.ndarray) -> np.ndarray:
    """For each function a hash of its two smallest k-mers in the order of the text."""
    h = kmers(words)
    if len(h) == 1:
        return mixed((h ^ _XOR[:, 0]) * _ODD[:, 0])
    out = np.empty(FUNCTIONS, np.uint64)
    step = max(1, min(FUNCTIONS, (1 << 20) // len(h)))
    for a in range(0, FUNCTIONS, step):
        x = (h ^ _XOR[a : a + step]) * _ODD[a : a + step]
        row = np.arange(len(x))
        one = x.argmin(1)
        x[row, one] = np.uint64(0xFFFFFFFFFFFFFFFF)
        two = x.argmin(1)
        out[a : a + step] = mixed(h[np.minimum(one, two)] * np.uint64(3) + mixed(h[np.maximum(one, two)]))
    return out


def remainders(words: np.ndarray) -> np.ndarray:
    """Hashes of what is left of a short text without any allowed() words or fewer: similar short texts share one."""
    n = len(words)
    if n > SHORT:
        return np.zeros(0, np.uint64)
    out = set()
    for left_out in range(allowed(n, n) + 1):
        for gone in combinations(range(n), left_out):
            h = 0
            for k, w in enumerate(words.tolist()):
                if k not in gone:
                    h = (h * 0x100000001B3 + w + 1) % (1 << 64)
            out.add(h)
    return mixed(np.array(sorted(out), np.uint64))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int, least: int = 0) -> int:
    """Edit distance of two arrays if it is at most `most`, else most + 1. It is known to be at least `least`.

    Furthest-reaching paths on the diagonals -most to most, the band: after e edits each diagonal is known by the
    furthest place that it reaches. Equal stretches are run through at once, by binary search over prefix hashes. That
    is quick for few edits; for more than FEW the band is walked column by column instead.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return most + 1
    low = min(n, m)
    differs = a[:low] != b[:low]
    head = int(differs.argmax()) if differs.any() else low
    a, b = a[head:], b[head:]
    low = min(len(a), len(b))
    if low:
        differs = a[::-1][:low] != b[::-1][:low]
        tail = int(differs.argmax()) if differs.any() else low
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return min(max(n, m), most + 1)
    if least > FEW:
        return banded_distance(a.tolist(), b.tolist(), most)
    base = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        powers = np.full(m + 1, base)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        pa_ = np.concatenate([[np.uint64(0)], np.cumsum(mixed(a) * powers[:n], dtype=np.uint64)])
        pb_ = np.concatenate([[np.uint64(0)], np.cumsum(mixed(b) * powers[:m], dtype=np.uint64)])
    steps = [1 << k for k in range(int(n).bit_length() - 1, -1, -1)]

    def run(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """i moved over the equal words of a[i:] and b[i + d:]."""
        limit = np.minimum(n, m - d)
        for s in steps:
            j = i + s
            ok = j <= limit
            jj, ii = np.where(ok, j, i), i
            x, y = pa_[jj] - pa_[ii], pb_[jj + d] - pb_[ii + d]
            # bring both to the same power: the one at the smaller place is multiplied
            up, down = np.maximum(d, 0), np.maximum(-d, 0)
            i = np.where(ok & (x * powers[up] == y * powers[down]), j, i)
        return i

    goal = m - n
    d = np.zeros(1, np.int64)
    i = run(np.zeros(1, np.int64), d)
    if goal == 0 and i[0] >= n:
        return 0
    for e in range(1, min(most, FEW) + 1):
        lo, hi = max(-e, -n, goal - (most - e)), min(e, m, goal + (most - e))
        nd = np.arange(lo, hi + 1)
        look = np.full(2 * e + 3, -2, np.int64)  # reach of diagonals -e - 1 to e + 1 before this edit
        look[d + e + 1] = i
        at = nd + e + 1
        limit = np.minimum(n, m - nd)
        within = lambda x: np.where(x <= limit, x, -2)  # noqa: B023, E731
        # a word replaced, one of a left out, one of b left out
        reach = np.maximum(within(look[at] + 1), np.maximum(within(look[at + 1] + 1), within(look[at - 1])))
        reach = np.maximum(reach, look[at])
        ok = reach >= np.maximum(0, -nd)
        nd, reach = nd[ok], reach[ok]
        if not len(nd):
            continue
        d, i = nd, run(reach, nd)
        if lo <= goal <= hi and ((d == goal) & (i >= n)).any():
            return e
    return banded_distance(a.tolist(), b.tolist(), most) if most > FEW else most + 1


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two lists, b no shorter than a, if it is at most `most`, else most + 1.

    A column of the alignment's table for each word of a. Of a column only the band of 2 * most + 1 rows around the
    diagonal is kept, as the bits of two numbers: where a cell is one more, or one less, than the cell above it. Bit k
    of column j is row j - most + k.
    """
    n, m = len(a), len(b)
    most = min(most, m)
    if m - n > most:
        return most + 1
    places: dict[int, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full >> most << most, 0
    # the cell at the band's lower edge, then, once that has come to the last row, the cell of that row
    cost, last = most, 1 << (width - 1)
    limit = most + n - (m - most)  # in the last row the cost can fall by one a column
    for j in range(1, n + 1):
        equal = places.get(a[j - 1], 0)
        shift = j - most - 1
        equal = (equal >> shift if shift >= 0 else equal << -shift) & full
        level = (((equal & up) + up) ^ up | equal | down) & full  # no more than the cell up and left of it
        right = down | full ^ (level | up)
        left = level & up
        if j <= m - most:
            cost += not level & last
        else:
            last >>= 1
            cost += bool(right & last) - bool(left & last)
        if cost > limit:
            return most + 1
        level >>= 1
        up = left | full ^ (level | right)
        down = level & right
    return cost if cost <= most else most + 1


def allowed(n: int, m: int) -> int:
    """The largest edit distance at which texts of n and m words are similar."""
    return int(np.floor((1 - SIMILARITY) * max(n, m) + 1e-9))


def labelled(words: np.ndarray) -> np.ndarray:
    """The words' hashes, sorted, each mixed with how often it occurred before."""
    s = np.sort(words)
    place = np.arange(len(s))
    first = np.concatenate([[True], s[1:] != s[:-1]])
    return mixed(s + (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64) * _LABEL)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the edit distance at most allowed()? Each word that only one text has takes an edit; that is tested first."""
    most = allowed(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return False
    both = np.concatenate([labelled(a), labelled(b)])
    shared = len(both) - len(np.unique(both))
    least = max(len(a), len(b)) - shared
    return least <= most and edit_distance(a, b, most, least) <= most


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, doc_id, text) to (key, doc_id, sketch, words): FUNCTIONS hashes, after them the remainders of a short text.

    An empty sketch if there is no word.
    """
    hashes = _Hashes()
    for batch in batches:
        out, ends, sizes = [], [0], []
        for text in batch.column(2):
            words = words_of(text.as_py())
            if words:
                with np.errstate(over="ignore"):
                    numbers = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    out += [sketch(numbers), remainders(numbers)]
            ends.append(ends[-1] + (len(out[-1]) + FUNCTIONS if words else 0))
            sizes.append(len(words))
        flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), made, pa.array(sizes, pa.int32())], names=["key", "doc_id", "sketch", "words"]
        )


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """A stored table of (key, group): the smallest key of each vertex's connected component. edges: a, b; each undirected link once.

    Each round links every vertex's neighbours to the smallest of them (large star), then the smaller ones (small star);
    ends when nothing changes, which takes about the logarithm of the longest path. Each round is a table in the shared
    folder. Raises if it hasn't ended after so many rounds.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = stored(now, "links")
    signature = lambda links: links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("a").alias("b"), F.col("b").alias("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        ).distinct()
        large = stored(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.*")
            .where("a <> b")
            .distinct()
        )
        small = stored(small, "links")
        changed = signature(small) != signature(now)
        drop_stored(now)
        drop_stored(large)
        now = small
        if not changed:
            break
    else:
        raise RuntimeError(f"the components are not complete after {rounds} rounds")
    roots = now.select(F.col("b").alias("key"), F.col("b").alias("group")).distinct()
    out = stored(now.select(F.col("a").alias("key"), F.col("b").alias("group")).unionByName(roots), "groups")
    drop_stored(now)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From links (a, b, their texts) to those whose texts are similar."""
    hashes = _Hashes()
    numbers = lambda w: np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    for batch in batches:
        keep = []
        with np.errstate(over="ignore"):
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(similar(numbers(words_of(x.as_py())), numbers(words_of(y.as_py()))))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, text) to (key, 32-bit hashes of the words)."""
    hashes = _Hashes()
    for batch in batches:
        made = []
        for text in batch.column(1):
            words = words_of(text.as_py())
            made.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "numbers"])


def _tokens(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of the different (hash, how often it occurred before in its text)."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    place = np.arange(len(h))
    first = np.ones(len(h), bool)
    first[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    label = np.empty(len(h), np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.unique(mixed(h + label * _LABEL), return_inverse=True)[1]


def _most(n: np.ndarray) -> np.ndarray:
    """allowed() for texts of which the longer has n words."""
    return np.floor((1 - SIMILARITY) * n + 1e-9).astype(np.int64)


def _steps(weights: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Slices of about `most` in weight."""
    ends = np.cumsum(weights)
    at = 0
    while at < len(weights):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(upto, at + 1)
        yield slice(at, upto)
        at = upto


def close_pairs(texts: list[np.ndarray], own: np.ndarray, wanted: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of texts of different classes that can be similar, and the words they share.

    texts: 32-bit hashes of words; own: classes as numbers; wanted(one, other): which of these pairs of texts to look at.
    An edit touches two pairs of neighbouring words, so similar texts share one of their 2 * allowed() + 1 pairs that
    are rarest here; and they share all but allowed() words.
    """
    size = np.array([len(w) for w in texts])
    most = _most(size)
    words = np.concatenate(texts).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    with np.errstate(over="ignore"):
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair_owner = owner[inner]
        pair = _tokens(pair_owner, mixed(words[inner] * np.uint64(_PLACE[0]) + words[inner + 1]))
        word = _tokens(owner, mixed(words))
    often = np.bincount(pair)
    order = np.lexsort((pair, often[pair], pair_owner))
    o, p = pair_owner[order], pair[order]
    start = np.searchsorted(o, np.arange(len(texts)))
    rank = np.arange(len(o)) - start[o]
    keep = (rank <= 2 * most[o] + 1) & (often[p] > 1)
    # postings by pair, and there by class; members of a pair's largest class need not look for each other
    o, p = o[keep], p[keep]
    # texts of one word or none have no pairs, and are similar to texts of the same words only
    order = np.lexsort((own[o], p))
    o, p = o[order], p[order]
    if not len(o):
        return (np.zeros(0, np.int64),) * 3
    run = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    part = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (own[o][1:] != own[o][:-1])]))
    n_run, n_part = np.diff(np.append(run, len(p))), np.diff(np.append(part, len(p)))
    run_of = np.repeat(np.arange(len(run)), n_run)
    part_run = run_of[part]
    best = np.lexsort((n_part, part_run))
    largest = best[np.append(np.flatnonzero(np.diff(part_run[best])), len(best) - 1)]
    seeks = np.ones(len(p), bool)
    for a, n in zip(part[largest].tolist(), n_part[largest].tolist(), strict=True):
        seeks[a : a + n] = False
    seekers = np.flatnonzero(seeks)
    met = np.zeros(len(texts) ** 2, bool)
    for s in _steps(n_run[run_of[seekers]]):
        at = seekers[s]
        n, a = n_run[run_of[at]], run[run_of[at]]
        one = np.repeat(o[at], n)
        other = o[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        met[np.minimum(one, other) * len(texts) + np.maximum(one, other)] = True
    one, other = np.divmod(np.flatnonzero(met), len(texts))
    ok = (own[one] != own[other]) & (np.abs(size[one] - size[other]) <= _most(np.maximum(size[one], size[other])))
    one, other = one[ok], other[ok]
    ok = wanted(one, other)
    one, other = one[ok], other[ok]
    # words that both have: those of the second that are marked as the first's
    first = np.concatenate([[0], np.cumsum(size)])
    shared = np.zeros(len(one), np.int64)
    marked = np.zeros(int(word.max()) + 1, bool)
    edge = np.append(np.flatnonzero(np.diff(one, prepend=-1)), len(one)).tolist()
    for a, b in zip(edge, edge[1:], strict=False):
        mine = word[first[one[a]] : first[one[a] + 1]]
        marked[mine] = True
        for s in _steps(size[other[a:b]]):
            their = other[a:b][s]
            n = size[their]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[their], n)
            shared[a:b][s] = np.add.reduceat(marked[word[places]], np.cumsum(n) - n, dtype=np.int64)
        marked[mine] = False
    longer = np.maximum(size[one], size[other])
    ok = longer - shared <= _most(longer)
    return one[ok], other[ok], shared[ok]


def _searched(found: pa.Table) -> pa.Table:
    """Links between classes in a part of a bucket, or in two of its parts: a, b, agree (words that they share).

    found: f, low, high, block, key, class, lower, numbers, sketch. Pairs that meet in a function before f are left to
    that one's bucket, and those of one band of length to the group of that band (`lower` tells the texts from below).
    """
    column = lambda n: found.column(n).combine_chunks()
    classes, key = column("class").to_pylist(), column("key")
    number = {c: k for k, c in enumerate(dict.fromkeys(classes))}
    own = np.array([number[c] for c in classes])
    out: list[tuple[int, int, int]] = []
    if len(number) > 1:
        f, two = column("f")[0].as_py(), column("low")[0] != column("high")[0]
        block, lower = np.array(column("block")), np.array(column("lower"))
        texts = [np.frombuffer(x.as_py(), np.uint32) for x in column("numbers")]
        earlier = np.frombuffer(b"".join(x.as_py() for x in column("sketch")), np.int32).reshape(len(texts), -1)[:, :f]

        def wanted(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            ok = ~(lower[one] & lower[other]) & ((block[one] != block[other]) | (not two))
            at = np.flatnonzero(ok)
            for s in _steps(np.full(len(at), f + 1)):
                ok[at[s]] = ~(earlier[one[at[s]]] == earlier[other[at[s]]]).any(1)
            return ok

        one, other, shared = close_pairs(texts, own, wanted)
        order = np.argsort(-shared, kind="stable")
        for x, y, n in zip(one[order].tolist(), other[order].tolist(), shared[order].tolist(), strict=True):
            if own[x] != own[y]:
                a, b = texts[x].astype(np.uint64), texts[y].astype(np.uint64)
                most, least = allowed(len(a), len(b)), max(len(a), len(b)) - n
                with np.errstate(over="ignore"):
                    if edit_distance(a, b, most, least) <= most:
                        out.append((x, y, n))
                        own[own == own[y]] = own[x]
    take = lambda k: key.take(pa.array([x[k] for x in out], pa.int64()))
    return pa.table({"a": take(0), "b": take(1), "agree": pa.array([x[2] for x in out], pa.int64())})


def _short_sketch(sketch: Column) -> Column:
    """32 bits of each function, as bytes."""
    low = F.transform(F.slice(sketch, 1, FUNCTIONS), lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.unhex(F.array_join(low, ""))


def within_buckets(met: DataFrame, groups: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b, agree: links between classes of a bucket, by word hashes. met: f, h, key, n, words; sketches: key, sketch."""
    # in a bucket of two the centre's link is the only pair
    many = met.where("n > 2").join(groups, "key", "left").withColumn("class", F.coalesce("group", "key"))
    many = stored(many.select("f", "h", "key", "words", "class"), "many")
    mixed_ = many.groupBy("f", "h").agg(
        F.min("class").alias("_low"), F.max("class").alias("_high"), F.count(F.lit(1)).alias("_n"),
        F.bit_xor(F.xxhash64("key")).alias("_x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("_y"),
    ).where("_low <> _high")
    # buckets of the same texts are searched once, in their first function
    once = mixed_.groupBy("_n", "_x", "_y").agg(F.min(F.struct("f", "h")).alias("_q")).select("_q.f", "_q.h")
    once = stored(once, "mixed")
    # similar texts are in one band of length or in neighbouring ones: each text looks in its own and in the one above
    band = F.floor(F.log(F.greatest("words", F.lit(1))) / F.log(F.lit(1 / SIMILARITY)) + 1e-9).cast("int")
    there = many.join(once, ["f", "h"]).withColumn("lower", F.explode(F.array(F.lit(False), F.lit(True))))
    there = there.withColumn("band", band + F.col("lower").cast("int"))
    sizes = there.groupBy("f", "h", "band").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("words").alias("_w"), F.min("class").alias("_low"), F.max("class").alias("_high"),
        F.min("lower").alias("_lower"),
    ).where("not _lower")
    parts = F.greatest(F.ceil(F.col("_n") / PART), F.ceil(F.col("_w") / PART_WORDS)).cast("int")
    sizes = stored(sizes.where("_low <> _high").select("f", "h", "band", parts.alias("parts")), "bands")
    found = stored(
        there.join(sizes, ["f", "h", "band"])
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), "parts").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "f", "h", "band", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block",
            "key", "class", "lower",
        ),
        "search",
    )
    numbers = texts.join(found.select("key").distinct(), "key", "left_semi").select("key", "text")
    numbers = numbers.mapInArrow(_numbers, "key binary, numbers binary").join(sketches, "key")
    numbers = stored(numbers.select("key", "numbers", _short_sketch(F.col("sketch")).alias("sketch")), "numbers")
    out = found.join(numbers, "key").groupBy("f", "h", "band", "low", "high").applyInArrow(
        _searched, "a binary, b binary, agree long"
    )
    # a pair may meet in several buckets
    out = stored(out.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("agree").alias("agree")), "close")
    for t in (many, once, sizes, found, numbers):
        drop_stored(t)
    return out


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each different text of docs: key, class_id (null if the class has no doc_id), and chosen.

    chosen: is it the text of its class with the smallest doc_id (of equal doc_ids, the one with the smallest key)?
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(F.col(text_col)).alias("key"),
        F.col(text_col).cast("binary").alias("text"),
    )
    made = rows.where("key is not null").select("key", "doc_id", "text").mapInArrow(
        _sketches, "key binary, doc_id long, sketch array<long>, words int"
    )
    # a vertex for each different text; partial aggregation leaves one row for each task that has the text
    vertices = stored(
        made.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("words").alias("words")),
        "vertices",
    )
    members = vertices.select(F.posexplode("sketch").alias("f", "h"), "key", "words")
    members = members.withColumn("f", F.least("f", F.lit(FUNCTIONS)))
    centres = members.groupBy("f", "h").agg(F.min("key").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    centres = stored(centres, "centres")
    met = stored(members.join(centres, ["f", "h"]), "met")
    links = met.where("key <> centre").groupBy(F.col("key").alias("a"), F.col("centre").alias("b")).agg(
        F.count(F.lit(1)).alias("agree"), F.min("n").alias("n")
    )
    links = stored(links, "links")
    # one row for each text that shares a bucket, with the text. Copies are left out before the join and by its keys, so that
    # texts are shuffled once; with the id among the keys a large group of copies is spread
    by = ["key", "_id", "_null"]
    keys = {"_id": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()}
    linked = vertices.join(met.select("key").distinct(), "key", "left_semi").withColumns(keys).select(*by)
    texts = rows.where("key is not null").withColumns(keys).select(*by, "text").dropDuplicates(by)
    texts = stored(texts.join(linked, by, "left_semi").select("key", "text"), "texts")

    def verify(some: DataFrame) -> DataFrame:
        of = lambda v: texts.select(F.col("key").alias(v), F.col("text").alias(f"t{v}"))
        whole = some.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")
        # alignments are the work, not bytes: so dealt evenly, whatever their size
        return stored(whole.repartition("a", "b").mapInArrow(_verified, "a binary, b binary"), "verified")

    def between(left: DataFrame, groups: DataFrame) -> DataFrame:
        """Links between different classes, with the classes ga and gb."""
        own = lambda v: groups.select(F.col("key").alias(v), F.col("group").alias(f"g{v}"))
        named = left.join(own("a"), "a", "left").join(own("b"), "b", "left")
        named = named.withColumns({f"g{v}": F.coalesce(f"g{v}", v) for v in ("a", "b")})
        return named.where("ga <> gb")

    best = links.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
    first = verify(best)
    groups = components(first)
    # links to the centre of a larger bucket are among the pairs that its search finds
    rest = links.where("n = 2").select("a", "b", "agree").unionByName(within_buckets(met, groups, texts, vertices.select("key", "sketch")))
    rest = stored(between(rest, groups), "rest")
    pairs = rest.groupBy(F.least("ga", "gb").alias("low"), F.greatest("ga", "gb").alias("high")).agg(
        F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("x")
    )
    tried = stored(pairs.select("x.a", "x.b"), "tried")
    second = verify(tried)
    sure = first.unionByName(second)
    drop_stored(groups)
    groups = components(sure)
    third = verify(between(rest.select("a", "b", "agree").join(tried, ["a", "b"], "left_anti"), groups))
    drop_stored(groups)
    groups = components(sure.unionByName(third))
    leaders = groups.select("key", F.col("group").alias("leader"))
    named = vertices.select("key", "doc_id").join(leaders, "key", "left").withColumn("leader", F.coalesce("leader", "key"))
    # stored, so that a large class is no single task of the join below
    named = stored(named, "named")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    names = stored(named.groupBy("leader").agg(F.min("doc_id").alias("class_id"), F.min_by("key", order).alias("_chosen")), "names")
    out = named.join(names, "leader").select("key", "class_id", (F.col("key") == F.col("_chosen")).alias("chosen"))
    out = stored(out, "classes")
    for t in (vertices, centres, met, links, texts, first, second, third, tried, rest, groups, named, names):
        drop_stored(t)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text; null for a null text) and class_id for each row of docs."""
    by_key = text_classes(docs, id_col, text_col).select(F.col("key").alias("_key"), "class_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"))
    named = rows.where("key is not null").join(by_key, F.col("key") == F.col("_key"), "left").select("doc_id", "key", "class_id")
    return named.unionByName(rows.where("key is null").withColumn("class_id", F.col("doc_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with one row of each class: of its chosen text the row that is smallest, doc_id first.

    Rows with a null text all stay. Rows are told apart by their texts, so null and repeated doc_ids do no harm.
    """
    classes = text_classes(docs, id_col, text_col)
    keyed = docs.withColumn("_key", text_key(F.col(text_col)))
    often = keyed.where("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    copied = stored(often.join(classes.where("chosen").select(F.col("key").alias("_key")), "_key", "left_semi"), "copied")
    gone = classes.where("not chosen").select(F.col("key").alias("_key")).unionByName(copied)
    single = keyed.join(gone, "_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    names = [id_col, *[c for c in docs.columns if c not in (id_col, text_col)]]
    order = F.struct(F.col(id_col).isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    one = keyed.join(copied, "_key", "left_semi").groupBy("_key").agg(F.min(order).alias("_row"), F.first(text_col).alias("_text"))
    fields = {c: F.col("_row")[f"c{k}"] for k, c in enumerate(names)} | {text_col: F.col("_text")}
    return single.unionByName(one.select(*[fields[c].alias(c) for c in docs.columns]))
