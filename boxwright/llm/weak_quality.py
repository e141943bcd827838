"""Quality classifier from weak labels.

Heuristic labellers vote on each text: good, bad, or no opinion. Nobody says how right they are: expectation
maximisation estimates, for each labeller, how it votes on good and on bad texts, together with the share of bad ones.
It needs only how often each pattern of votes occurs, so the corpus is read once for it, whatever its size, and at most
4 ** labellers counts reach the driver.

The posterior of a text's votes is its label for a linear scorer over hashed byte n-grams (1 to 4 bytes, and the same
of character classes), fitted on the driver to a bounded sample: at most MOST_TEXTS different texts, those with the
smallest hashes (ties go by the text itself), and of those the first that have MOST_FEATURES features together. A text has at
most SPACE features of 4 bytes, so the sample takes at most 4 * MOST_FEATURES bytes, however long its texts are. The scorer then
reads every whole text. A text's features are mean weights over its n-grams, so long texts are like short ones.

Null and empty texts give no votes and no features: their score is that of the scorer's bias. If all texts of the
sample are of one kind, every score is that kind's. Rows repeat as they are, copies of a text have one score. An empty table gives
an empty result. The columns of docs come back inside a struct, so none of them can clash with what is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

MOST_TEXTS = 2500
MOST_FEATURES = 1 << 24
#: Features of the sample that one step of the fit looks at at once.
STEP_FEATURES = 1 << 19
SPACE = 1 << 16
#: Texts with a lower score are rejected. Below a half, so that short texts of which little is known stay.
LEAST_SCORE = 0.35
ROUNDS = 120
#: Shares of n-grams are kept as 16-bit floats of this unit.
SHARE_UNIT = 100.0
#: NOT: too short to be judged, as if the labeller weren't there.
GOOD, BAD, NONE, NOT = 1, 0, -1, 2

_SPACE_BYTES = b" \t\n\x0b\x0c\r"
_DROP = {
    "letters": bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128)),
    "upper": bytes(c for c in range(256) if not 65 <= c <= 90),
    "symbols": bytes(c for c in range(256) if c not in b"#*$%&|<>=+_/\\^~@{}[]"),
    "marks": bytes(c for c in range(256) if c not in b"!?"),
    "digits": bytes(c for c in range(256) if not 48 <= c <= 57),
}
_SENTENCE = re.compile(rb"[.!?][\"')]?(?:\s|$)")
#: Frequent function words of several languages.
_FUNCTION_WORDS = frozenset(
    b"the of and to in is that was for it with as der die und den von zu das mit sich des auf "
    b"la le et les en un du une que est de el y a los se del las".split()
)
#: Byte classes for the n-grams of character classes.
_CLASS = np.frombuffer(
    bytes(
        65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 200 if c >= 128 else c
        for c in range(256)
    ),
    np.uint8,
)


def votes(text: bytes | None) -> list[int]:
    """What each labeller says of a text."""
    text = text or b""
    words = text.split()
    n, chars = len(words), sum(map(len, words))
    if not n:
        return [NOT] * len(LABELLERS)
    count = {k: len(text.translate(None, drop)) for k, drop in _DROP.items()}
    letters = max(1, count["letters"])
    lower = [w.strip(b".,;:!?").lower() for w in words]
    function = sum(map(_FUNCTION_WORDS.__contains__, lower))
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], words[2:], strict=False)))
    sentence = n / max(1, len(_SENTENCE.findall(text)))
    long_enough = n >= 20
    bad = lambda found: BAD if found else NONE
    return [
        # a detector of one fault says nothing of texts without it
        bad(count["symbols"] > 0.06 * chars),
        bad(count["upper"] > 0.4 * letters),
        bad(count["marks"] > 0.15 * n),
        bad(pairs < 0.7 * (n - 2)) if long_enough else NOT,
        bad(len(set(lines)) < 0.75 * len(lines)) if len(lines) >= 4 else NOT,
        bad(count["digits"] > 0.3 * chars),
        # prose has many function words, and sentences of a usual length
        (GOOD if function > 0.12 * n else BAD if function < 0.05 * n else NONE) if long_enough else NOT,
        (GOOD if 3 <= sentence <= 45 else BAD if sentence > 80 else NONE) if long_enough else NOT,
    ]


LABELLERS = ("symbols", "upper_case", "marks", "repeats", "equal_lines", "digits", "function_words", "sentences")


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [bytes(v + 1 for v in votes(t.as_py())) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["votes"])


class LabelModel:
    """Two classes, independent labellers: how often each votes what on good and bad texts, and the share of good ones.

    No opinion is a vote of its own. Prior counts say that votes are right more often than not; they weigh as much as
    PRIOR of the texts.
    """

    PRIOR = 0.05
    #: Shares of no opinion, bad and good, on bad and on good texts.
    EXPECTED = np.array([[0.45, 0.45, 0.10], [0.39, 0.01, 0.60]])

    def __init__(self, patterns: dict[bytes, int], rounds: int = 100) -> None:
        keys = list(patterns)
        vote = np.array([list(k) for k in keys], np.int64).reshape(len(keys), len(LABELLERS))
        weight = np.array([patterns[k] for k in keys], float)
        self.rates = np.repeat(self.EXPECTED[None], len(LABELLERS), 0)  # labeller, class, vote
        self.good = 0.8
        n = weight.sum()
        for _ in range(rounds if n else 0):
            p = self._posterior(vote)
            shares = np.stack([weight * (1 - p), weight * p])
            self.good = float(np.clip(shares[GOOD].sum() / n, 0.02, 0.98))
            prior = self.PRIOR * n * np.array([1 - self.good, self.good])[:, None] * self.EXPECTED
            for k in range(len(LABELLERS)):
                for kind in (BAD, GOOD):
                    found = np.bincount(vote[:, k], shares[kind], 4)[:3] + prior[kind] + 1e-3
                    self.rates[k, kind] = found / found.sum()

    def _posterior(self, vote: np.ndarray) -> np.ndarray:
        odds = np.full(len(vote), np.log(self.good / (1 - self.good)))
        for k in range(len(LABELLERS)):
            odds += np.append(np.log(self.rates[k, GOOD] / self.rates[k, BAD]), 0.0)[vote[:, k]]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def posterior(self, pattern: bytes) -> float:
        """Probability that a text with these votes (each one more than GOOD, BAD or NONE) is good."""
        return float(self._posterior(np.array([list(pattern)], np.int64))[0])

    def accuracies(self) -> dict[str, float]:
        """For each labeller the probability that an opinion of its is right."""
        share = np.array([1 - self.good, self.good])[None, :, None] * self.rates
        right = share[:, BAD, BAD + 1] + share[:, GOOD, GOOD + 1]
        return dict(zip(LABELLERS, (right / (share[:, :, BAD + 1] + share[:, :, GOOD + 1]).sum(1)).tolist(), strict=True))


def grams(text: bytes | None) -> np.ndarray:
    """Numbers of all n-grams of a text, of its bytes and of its character classes, and of how much of it repeats."""
    raw = np.frombuffer(text or b"", np.uint8)
    out = []
    for salt, x in ((1, raw), (2, _CLASS[raw])):
        h = x.astype(np.uint32) + np.uint32(salt * 257)
        for n in range(1, 5):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
            if n > 2 or salt == 2 or n == 1:
                out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32))
        if salt == 1 and len(h) > 4:
            # how much of the text repeats, in steps of a twentieth, as an eighth of all features
            runs = h[:-4] * np.uint32(0x85EBCA6B) ^ h[4:]
            step = int(20 * (1 - len(np.unique(runs)) / len(runs)))
            out.append(np.full(len(raw), (step + 1) * 2999 % SPACE, np.int32))
    return np.concatenate(out)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, shares, vote = [], [], []
        for t in batch.column(0):
            text = t.as_py()
            g = grams(text)
            number, often = np.unique(g, return_counts=True)
            made.append(number.astype(np.uint16).tobytes())
            shares.append((often / max(1, len(g)) * SHARE_UNIT).astype(np.float16).tobytes())
            vote.append(bytes(v + 1 for v in votes(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(made, pa.binary()), pa.array(shares, pa.binary()), pa.array(vote, pa.binary())],
            names=["numbers", "shares", "votes"],
        )


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, classes weighed alike, by Adam.

    rows: numbers of features (16 bits) and their shares in SHARE_UNIT (16 bits). A step goes over them in slices of about
    STEP_FEATURES features, so that nothing wider than they are is made of all of them.
    """
    w, b = np.zeros(SPACE), 0.0
    if not rows or good.sum() < 1 or (1 - good).sum() < 1:
        return w, (3.0 if not len(rows) or good.mean() >= 0.5 else -3.0)
    size = np.array([len(r[0]) for r in rows])
    col, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    rows.clear()
    ends = np.cumsum(size)
    edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP_FEATURES, ends[-1], STEP_FEATURES), "right"), [len(size)]])).tolist()
    weight = good / good.sum() + (1 - good) / (1 - good).sum()
    weight /= weight.sum()
    m, v, mb, vb = np.zeros(SPACE), np.zeros(SPACE), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        gw, gb = 1e-6 * w, 0.0
        for first, last in zip(edges, edges[1:], strict=False):
            at = slice(ends[first] - size[first], ends[last - 1])
            x, share = col[at].astype(np.int64), val[at].astype(float)
            row = np.repeat(np.arange(last - first), size[first:last])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[x] * share, last - first) + b, -50, 50)))
            g = weight[first:last] * (p - good[first:last])
            gw += np.bincount(x, g[row] * share, SPACE)
            gb += g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.03 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.03 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w * SHARE_UNIT, float(b)


def train(docs: DataFrame, text_col: str = "text") -> tuple[LabelModel, np.ndarray, float]:
    """The label model and the scorer's weights and bias."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(_vote_rows, "votes binary").groupBy("votes").count().collect()  # at most 4 ** labellers
    model = LabelModel({bytes(r["votes"]): r["count"] for r in counts})
    # copies of a text are one text of the sample, so that no group of them can fill it
    hashed = rows.withColumn("hash", F.xxhash64("text", F.lit(5)))
    n = hashed.agg(F.approx_count_distinct("hash", 0.02)).first()[0]
    place = F.pmod("hash", F.lit(1 << 30))
    chosen = hashed.where(place < int(min(1.0, 1.2 * MOST_TEXTS / max(1, n)) * (1 << 30))).dropDuplicates(["hash"])
    sample = chosen.orderBy(place, "hash", "text").limit(MOST_TEXTS).select("text").mapInArrow(_sample_rows, "numbers binary, shares binary, votes binary")
    features, good, n = [], [], 0
    for r in sample.toLocalIterator():
        n += len(r["shares"]) // 2
        if n > MOST_FEATURES:
            break
        features.append((np.frombuffer(r["numbers"], np.uint16), np.frombuffer(r["shares"], np.float16)))
        good.append(model.posterior(bytes(r["votes"])))
    weights, bias = fit_scorer(features, np.array(good))
    return model, weights, bias


def scored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row`, a struct of the columns of docs, and `score`, the scorer's probability that its text is good."""
    _, weights, bias = train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # SPACE weights
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            out = []
            for t in batch.column(0).field(place):
                text = t.as_py()
                g = grams(text.encode() if isinstance(text, str) else text)
                out.append(float(w[g].mean(dtype=np.float64)) + b if len(g) else b)
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("score", DoubleType()))


def keep_good(docs: DataFrame, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is at least `least`."""
    return scored(docs, text_col).where(F.col("score") >= least).select("row.*")
