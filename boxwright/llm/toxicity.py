"""Toxicity: non-negative positive-unlabelled learning of linear classifiers over words.

Confirmed toxic texts are the positives; a sample of all texts, whatever their labels, is unlabelled. The risk of a classifier g is

    prior * R_p(g, +1) + max(0, R_u(g, -1) - prior * R_p(g, -1))

with the logistic loss; where the second part is negative, its gradient is turned round, so that it can't be pushed
below zero by fitting the positives. The class prior is the share of toxic ones among the labelled texts that may be
learned from. Several classifiers with different initial weights and halves of the unlabelled sample are averaged.

A text is its set of hashed words, whatever its length: the features are present or not. Only words that are clearly
more or less frequent among the positives get a weight, and a proximal step in each round takes small weights to zero,
so that the thousands of neutral words of a long text add nothing. Classifiers are fitted on the driver to bounded samples of
different texts: at most MOST_POSITIVE confirmed ones, of as many ids, and MOST_UNLABELLED others, those with the smallest
hashes, and of either so many of the first that they have MOST_FEATURES words in all, however long they are. Samples are of texts, so repeated
ids or rows can't make them larger. Scoring reads every whole text once; a task holds one text's words at a time.

Nothing but the text enters a score, so equal texts have equal scores. Null and empty texts have the score of a text without
known words. Labels of texts that aren't there have no effect; repeated labels count as toxic if one of them says so, null
labels and labels of a null id don't count. Rows with a null id are not held out; rows with a repeated id share its label. If
there are no positives or no unlabelled texts, every score is the prior (0 without any label). An empty table gives an empty
result; of both tables only the named columns are read, whatever the others are called.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import drop_stored, stored, words_of

MOST_POSITIVE = 6000
MOST_UNLABELLED = 12000
#: Features of a sample, 4 bytes each on the driver; a text has at most SPACE of them.
MOST_FEATURES = 16 << 20
#: Hashed words; a word's number is its CRC-32 modulo this.
SPACE = 1 << 20
LEAST_TEXTS = 5
DEVIATIONS = 5.0
LASSO = 0.00003
ROUNDS = 1000
MODELS = 3


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = zlib.crc32(word) % SPACE
        return n


def features(text: bytes | None, numbers: dict) -> np.ndarray:
    """The text's hashed words, sorted, each once."""
    return np.unique(np.fromiter(map(numbers.__getitem__, set(words_of(text))), np.int32))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Sparse:
    """Rows of sorted feature numbers."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, g[self.rows], size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def nn_pu(positive: Sparse, unlabelled: Sparse, size: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk plus LASSO times the weights' sizes.

    Accelerated proximal gradient steps; the bias is free.
    """
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, size), np.log(prior / (1 - prior))
    # the risk's curvature is at most a quarter of the weighted squares of the rows
    bound = 0.25 * (2 * prior * (1 + len(positive.rows) / positive.n) + 1 + len(unlabelled.rows) / unlabelled.n)
    step, ahead, pw, pb = 1 / bound, 1.0, w, b
    for _ in range(ROUNDS):
        p, u = sigmoid(positive.dot(w) + b), sigmoid(unlabelled.dot(w) + b)
        # the logistic losses: -log(p) for +1, -log(1 - p) for -1
        rest = -np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
        if rest >= 0:
            gp, gu = np.full(positive.n, -prior / positive.n), u / unlabelled.n
        else:
            gp, gu = prior * p / positive.n, -u / unlabelled.n
        new = w - step * (positive.back(gp, size) + unlabelled.back(gu, size))
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * LASSO)
        new_b = b - step * (gp.sum() + gu.sum())
        after = (1 + math.sqrt(1 + 4 * ahead * ahead)) / 2
        w, b = new + (ahead - 1) / after * (new - pw), new_b + (ahead - 1) / after * (new_b - pb)
        pw, pb, ahead = new, new_b, after
    return pw, float(pb)


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The words whose shares of positive and of unlabelled texts differ by DEVIATIONS or more."""
    count = lambda rows: np.unique(np.concatenate(rows), return_counts=True)
    (a, na), (b, nb) = count(positive), count(unlabelled)
    words = np.union1d(a, b)
    n, m = np.zeros(len(words)), np.zeros(len(words))
    n[np.searchsorted(words, a)], m[np.searchsorted(words, b)] = na, nb
    p = (n + m) / (len(positive) + len(unlabelled))
    spread = np.sqrt(p * (1 - p) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
    z = np.where(n + m >= LEAST_TEXTS, np.abs(n / len(positive) - m / len(unlabelled)) / spread, 0)
    return np.sort(words[z >= DEVIATIONS])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) of the averaged classifier."""
    once = lambda rows: [*{r.tobytes(): r for r in rows if len(r)}.values()]  # noqa: E731  copies count once
    positive, unlabelled = once(positive), once(unlabelled)
    if not positive or not unlabelled or not 0 < prior < 1:
        odds = math.log(prior / (1 - prior)) if 0 < prior < 1 else (-60.0 if prior <= 0 else 60.0)
        return np.zeros(0, np.int32), np.zeros(0), odds
    known = telling(positive, unlabelled)
    inner = lambda rows: [np.searchsorted(known, r[np.isin(r, known, assume_unique=True)]) for r in rows]
    pos, unl = Sparse(inner(positive)), inner(unlabelled)
    models = [nn_pu(pos, Sparse(unl[k % 2 :: 2] or unl), len(known), prior, k) for k in range(MODELS)]
    w = np.mean([m[0] for m in models], axis=0)
    used = np.flatnonzero(w)
    return known[used].astype(np.int32), w[used], float(np.mean([m[1] for m in models]))


def _sample(docs: DataFrame, most: int, share: float = 1.0) -> list[np.ndarray]:
    """Features of at most `most` different texts, MOST_FEATURES in all: of about `share` of all texts, those with the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            made = [features(t.as_py(), numbers).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["place", "features"])

    place = F.xxhash64("text", F.lit(11))
    few = docs.select(place.alias("place"), "text").where(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)))
    made = few.mapInArrow(run, "place long, features binary").groupBy("place").agg(F.min("features").alias("features"))
    rows = stored(made.withColumn("rank", F.pmod("place", F.lit(1 << 30))), "toxicity-sample")
    # the places and sizes of the sample tell how many of its texts fit; only their features come to the driver
    sizes = rows.select("rank", "place", F.octet_length("features").alias("n")).orderBy("rank", "place").limit(most).collect()
    fits = int(np.searchsorted(np.cumsum([r["n"] // 4 for r in sizes]), MOST_FEATURES, "right"))
    if not fits:
        drop_stored(rows)
        return []
    last = sizes[fits - 1]
    key = lambda rank, place: F.struct(rank.alias("rank"), place.alias("place"))
    inside = key(F.col("rank"), F.col("place")) <= key(F.lit(last["rank"]), F.lit(last["place"]))
    found = sorted(rows.where(inside).collect(), key=lambda r: (r["rank"], r["place"]))
    drop_stored(rows)
    return [np.frombuffer(r["features"], np.int32) for r in found]


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; learned from labels of ids that aren't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    prior = (counts["toxic"] or 0) / counts["n"] if counts["n"] else 0.0
    # bounded by MOST_POSITIVE: small enough to be sent to all executors
    chosen = known.where("label = 1").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(MOST_POSITIVE).select("doc_id")
    positive = _sample(rows.join(F.broadcast(chosen), "doc_id", "left_semi"), MOST_POSITIVE)
    n = rows.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]
    # a share of the texts by hash, some more than wanted; those with the smallest hashes stay
    share = min(1.0, 1.2 * MOST_UNLABELLED / max(1, n))
    unlabelled = _sample(rows.where(~held_out(F.col("doc_id")) | F.col("doc_id").isNull()), MOST_UNLABELLED, share)
    used, weights, bias = fit(positive, unlabelled, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = defaultdict(float, zip(used.tolist(), weights.tolist(), strict=True))

        class Weights(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) > 500_000:
                    self.clear()
                x = self[word] = weight.get(zlib.crc32(word) % SPACE, 0.0)
                return x

        of = Weights()
        for batch in batches:
            # fsum doesn't depend on the order in which a set gives its words
            total = np.array([math.fsum(map(of.__getitem__, set(words_of(t.as_py())))) for t in batch.column(1)], float)
            p = sigmoid(total + bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
