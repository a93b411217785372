"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of itself and its two neighbours; the chain labels lines good or
bad. Forward-backward gives each line's probability of being good, and their mean, weighted
by line length, is the document's quality, calibrated to a probability. The chain is fitted
on the driver from a bounded sample of labelled documents whose lines all carry the
document's label; scoring runs over all documents in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import fresh, prefix_hash, run_hash, slices, table, utf8, word_runs

#: Labelled documents used for fitting at most, and their most lines (longer ones are not fitted on).
SAMPLE_DOCS, SAMPLE_LINES = 4000, 64
THRESHOLD = 0.3
FOLDS = 5
STEPS, RATE, PENALTY = 200, 0.1, 1e-3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "other": range(128, 256), "digit": range(48, 58),
    "space": (9, 11, 12, 13, 32), "plain": b".,;:'-()\"", "bar": b"|", "shout": b"!?",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
}
_OWN = 14
N_FEATURES = 3 * _OWN + 2


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features, length, row)`` per line of the texts in ``data``; a text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    row_starts, row_ends = offsets[:-1], offsets[1:]
    starts = np.concatenate([row_starts, breaks + 1])
    rows = np.concatenate([np.arange(len(row_starts)), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(rows[1:] == rows[:-1], starts[1:] - 1, row_ends[rows[:-1]])
    ends[-1:] = row_ends[rows[-1:]]
    length = ends - starts
    part = np.maximum(length, 1).astype(float)
    own = np.zeros((len(starts), _OWN))
    for k, members in enumerate(_CLASSES.values()):
        mark = np.zeros(256, bool)
        mark[list(members)] = True
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark[data], out=total[1:])
        own[:, k] = (total[ends] - total[starts]) / part
    w_start, w_end, _ = word_runs(data, offsets)
    prefix = prefix_hash(data)
    words = run_hash(prefix, w_start, w_end)
    line = np.searchsorted(starts, w_start, "right") - 1
    n = np.bincount(line, minlength=len(starts)).astype(float)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    k = len(_CLASSES)
    own[:, k] = np.bincount(line, same, len(starts)) / np.maximum(n, 1)
    own[:, k + 1] = np.bincount(line, w_end - w_start, len(starts)) / np.maximum(n, 1) / 10
    own[:, k + 2] = np.log1p(length) / 8
    own[:, k + 3] = length == 0
    own[:, k + 4] = 1
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    last = np.ones(len(rows), bool)
    last[:-1] = first[1:]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last]), length, rows


def _step(x: np.ndarray, to_good: tuple[float, float], to_bad: tuple[float, float]) -> np.ndarray:
    """Log-odds carried over one transition; each pair is (from good, from bad)."""
    return np.logaddexp(x + to_good[0], to_good[1]) - np.logaddexp(x + to_bad[0], to_bad[1])


def _messages(scores: np.ndarray, rows: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (own score included) and backward log-odds of all lines; documents run side by side."""
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    counts = np.diff(np.append(heads, len(rows)))
    order = np.argsort(-counts, kind="stable")
    heads, counts = heads[order], counts[order]
    live = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right") if len(counts) else []
    ahead, back = scores.copy(), np.zeros_like(scores)
    for k in range(1, len(live)):
        at = heads[: live[k]] + k
        ahead[at] += _step(ahead[at - 1], (t[1, 1], t[0, 1]), (t[1, 0], t[0, 0]))
    for k in range(len(live) - 1, 0, -1):
        at = heads[: live[k]] + k
        back[at - 1] = _step(scores[at] + back[at], (t[1, 1], t[1, 0]), (t[0, 1], t[0, 0]))
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def marginals(model: dict, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each line's probability of being good."""
    scores = ((features - model["mean"]) / model["scale"]) @ model["weights"]
    ahead, back = _messages(scores, rows, model["transitions"])
    return _sigmoid(ahead + back)


def _documents(good: np.ndarray, length: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted means per document."""
    weight = length + 1.0
    return np.bincount(rows, good * weight, n) / np.maximum(np.bincount(rows, weight, n), 1e-12)


def _odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def fit(features: np.ndarray, length: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> dict:
    """The chain and its calibration from lines of ``len(labels)`` documents, labels 0 or 1.

    Without documents of both classes there is nothing to tell apart: every score is then
    the smoothed share of good labels, one half without any.
    """
    d = features.shape[1]
    model = {"mean": np.zeros(d), "scale": np.ones(d), "weights": np.zeros(d), "transitions": np.zeros((2, 2)),
             "slope": 0.0, "shift": float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1)))}
    if len(np.unique(labels)) < 2:
        return model
    spread = features.std(0)
    constant = spread < 1e-9
    model["mean"] = np.where(constant, 0, features.mean(0))
    model["scale"] = np.where(constant, 1, spread)
    x = (features - model["mean"]) / model["scale"]
    y = labels[rows].astype(float)
    share = np.array([1 / (2 * np.mean(labels == 0)), 1 / (2 * np.mean(labels == 1))])
    weight = share[labels[rows]]  # both classes weigh alike
    joined = np.flatnonzero(rows[1:] == rows[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[joined].astype(int), y[joined + 1].astype(int)), weight[joined])
    theta, m1, m2 = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    for step in range(1, STEPS + 1):
        w, t = theta[:d], theta[d:].reshape(2, 2)
        scores = x @ w
        ahead, back = _messages(scores, rows, t)
        g = np.empty(d + 4)
        g[:d] = x.T @ (weight * (y - _sigmoid(ahead + back)))
        a, b = ahead[joined], (scores + back)[joined + 1]
        pair = np.stack([np.full_like(a, t[0, 0]), b + t[0, 1], a + t[1, 0], a + b + t[1, 1]])
        pair = np.exp(pair - pair.max(0))
        g[d:] = (seen - ((pair / pair.sum(0)) @ weight[joined]).reshape(2, 2)).ravel()
        g = g / len(rows) - PENALTY * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    model |= {"weights": theta[:d], "transitions": theta[d:].reshape(2, 2)}
    z = _odds(_documents(marginals(model, features, rows), length, rows, len(labels)))
    slope, shift = 0.5, 0.0
    for _ in range(50):  # Newton steps of a ridge-penalised logistic regression
        p = _sigmoid(slope * z + shift)
        v = p * (1 - p)
        grad = np.array([((labels - p) * z).sum() - 0.1 * slope, (labels - p).sum() - 0.1 * shift])
        hess = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        slope, shift = slope + move[0], shift + move[1]
    return model | {"slope": float(slope), "shift": float(shift)}


def fold(key) -> F.Column:
    """``crc32`` of the key as text modulo five; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE_DOCS) -> dict:
    """A model from at most ``sample`` labelled documents outside fold 0, chosen by a hash of the key.

    The sample is the only thing that reaches the driver; rows without a 0/1 label or a text are not used.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 0))
    chosen = usable.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).orderBy(
        F.xxhash64("_key"), "_key", "_label").limit(sample)
    lines = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    rows = docs.where(F.col(text).isNotNull() & (lines <= SAMPLE_LINES)).select(
        F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            features, length, row = line_features(*utf8(part.column("_text")))
            cut = np.flatnonzero(np.diff(row)) + 1
            yield pa.RecordBatch.from_arrays(
                [part.column("_key"), part.column("_label"),
                 pa.array([x.astype("<f8").tobytes() for x in np.split(features, cut)], pa.binary()),
                 pa.array([x.astype("<i8").tobytes() for x in np.split(length, cut)], pa.binary())],
                ["_key", "_label", "features", "length"])

    kind = rows.schema["_key"].dataType.simpleString()
    made = rows.select("_key", "_label", "_text").mapInArrow(
        run, f"_key {kind}, _label int, features binary, length binary").limit(2 * sample).collect()
    made.sort(key=lambda r: (r._key, bytes(r.features), r._label))
    if not made:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    features = [np.frombuffer(r.features, "<f8").reshape(-1, N_FEATURES) for r in made]
    return fit(np.concatenate(features), np.concatenate([np.frombuffer(r.length, "<i8") for r in made]),
               np.repeat(np.arange(len(made)), [len(x) for x in features]), np.array([r._label for r in made]))


def score_texts(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Quality of each text in ``data``."""
    features, length, rows = line_features(data, offsets)
    quality = _documents(marginals(model, features, rows), length, rows, len(offsets) - 1)
    return _sigmoid(model["slope"] * _odds(quality) + model["shift"])


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability of label 1, from the text alone.

    NULL and empty texts are one empty line and get that line's score; a column that
    already carries the name is replaced; equal texts have equal scores.
    """
    kept = docs.drop(name)
    (inner,) = fresh(kept.columns, "_score")
    at = kept.columns.index(text)
    flat = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            data, offsets = utf8(part.column(at))
            found = score_texts(model, data, offsets) if part.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, inner])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    return flat.mapInArrow(run, f"{schema}, {inner} double").toDF(*kept.columns, name)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose quality reaches ``threshold``; columns stay."""
    (name,) = fresh(docs.columns, "_quality")
    return score(docs, train(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
