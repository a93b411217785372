"""Personal data by patterns plus a semi-Markov conditional random field.

Patterns with checks find the base spans. Around characters that can belong to personal data the
text is cut into atoms, and a semi-Markov field scores whole candidate segments of bounded length per
type; dynamic programming picks boundaries and types together. It is fitted on the base spans of a
bounded sample and adds segments of the same make that the patterns miss. Base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")
#: Atoms of a segment at most.
MOST_ATOMS = 24
#: Documents sampled for fitting, windows used and their most atoms.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_ATOMS = 4000, 400, 80
EPOCHS, RATE, PENALTY = 25, 0.1, 1e-2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(n: str) -> bool:
    return len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern spans, sorted; kinds are places in :data:`KINDS`.

    An address is read from its at sign: the local part reaches back as far as it can, which is where a
    search from the left would have begun.
    """
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            found.append((start, 0, m.end()))
        at = text.find("@", done)
    if _HINT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words, one space apart, that each hold a digit or an at sign."""
    done = 0
    for m in _HINT.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while True:
            while end < len(text) and not text[end].isspace():
                end += 1
            nxt = end + 1
            if end >= len(text) or text[end] != " " or nxt >= len(text) or text[nxt].isspace():
                break
            while nxt < len(text) and not text[nxt].isspace():
                nxt += 1
            if not _HINT.search(text, end, nxt):
                break
            end = nxt
        yield start, end
        done = end


N_FEATURES = 20


def span_features(s: str, before: str, after: str) -> list[float]:
    """What a whole candidate looks like: its make, its sums and the characters around it."""
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    d, letters = len(digits), sum(c.isalpha() for c in s)
    at = s.find("@")
    dotted = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s) is not None
    numeric = letters == 0 and at < 0
    phone_like = numeric and (s[0] in "+(" or "(" in s)
    return [
        1.0, float(s.count("@") == 1 and at > 0), float(at > 0 and _DOMAIN.fullmatch(s, at + 1) is not None),
        float(at > 0 and all(c in _LOCAL for c in s[:at])), float(at < 0 and letters > 0), float(at > 0 and d > 0),
        float(dotted), float(dotted and all(map(_small, groups))), float(numeric and s[0] == "+"),
        float(phone_like and 9 <= d <= 15), float(numeric and 9 <= d <= 15), float(numeric and 12 <= d <= 19),
        float(numeric and 12 <= d <= 19 and luhn(digits)), float(numeric and d < 9 and not dotted),
        float(numeric and d > 19), float("." in s and numeric and not dotted),
        float(before.isalnum() or before in "@+"), float(after.isalnum() or after == "@"),
        float(not (s[0].isalnum() or s[0] in "+(")), len(s) / 20,
    ]


def lattice(text: str, start: int, end: int, blocked: list[tuple[int, int, int]] = ()) -> tuple:
    """Atoms of a window and its candidate segments: ``(atoms, pairs, features)``.

    A segment begins with a letter, digit, plus or bracket, ends with a letter or digit, holds a digit or an
    at sign, and touches no blocked span.
    """
    atoms = [(start + m.start(), start + m.end()) for m in _ATOM.finditer(text[start:end])]
    bad = np.zeros(len(atoms) + 1, np.int64)
    for a, _, b in blocked:
        for i, (x, y) in enumerate(atoms):
            bad[i] |= x < b and a < y
    pairs, rows = [], []
    for i, (a, _) in enumerate(atoms):
        if bad[i] or not (text[a].isalnum() or text[a] in "+("):
            continue
        useful = False
        for j in range(i, min(i + MOST_ATOMS, len(atoms))):
            if bad[j]:
                break
            c, b = atoms[j]
            useful = useful or text[c] == "@" or text[c] in "0123456789"
            if useful and text[c].isalnum():
                pairs.append((i, j + 1))
                rows.append(span_features(text[a:b], text[a - 1:a] or " ", text[b:b + 1] or " "))
    return atoms, pairs, np.array(rows).reshape(len(rows), N_FEATURES)


def best_segments(weights: np.ndarray, n: int, pairs: list, features: np.ndarray) -> list[tuple[int, int, int]]:
    """``(first, last + 1, kind)`` of the best labelling of ``n`` atoms; an atom outside segments scores 0."""
    if not pairs:
        return []
    scores = features @ weights.T
    kinds, tops = scores.argmax(1), scores.max(1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j) in enumerate(pairs):
        if tops[k] > 0:
            ending[j].append(k)
    best, via = np.zeros(n + 1), np.full(n + 1, -1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending[j]:
            value = best[pairs[k][0]] + tops[k]
            if value > best[j]:
                best[j], via[j] = value, k
    out, j = [], n
    while j > 0:
        if via[j] < 0:
            j -= 1
        else:
            out.append((*pairs[via[j]], int(kinds[via[j]])))
            j = pairs[via[j]][0]
    return out[::-1]


def expected(weights: np.ndarray, n: int, pairs: list, features: np.ndarray) -> np.ndarray:
    """Expected features per kind under the field, by forward and backward sums over segment ends."""
    scores = features @ weights.T
    total = np.logaddexp.reduce(scores, 1)
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(pairs):
        ending[j].append(k)
        starting[i].append(k)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[pairs[k][0]] + total[k] for k in ending[j]]])
    for i in range(n - 1, -1, -1):
        back[i] = np.logaddexp.reduce([back[i + 1], *[back[pairs[k][1]] + total[k] for k in starting[i]]])
    first, last = np.array(pairs).T
    return np.exp(ahead[first][:, None] + scores + back[last][:, None] - ahead[n]).T @ features


def fit(samples: list[str]) -> np.ndarray:
    """Weights per kind from texts whose base spans are the truth; without any span nothing is added later."""
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -5
    cases = []
    for text in samples:
        spans = {(a, b): k for a, k, b in base_spans(text)}
        atoms, pairs, features = lattice(text, 0, len(text))
        if not pairs:
            continue
        truth = np.zeros_like(weights)
        for (i, j), f in zip(pairs, features, strict=True):
            kind = spans.get((atoms[i][0], atoms[j - 1][1]))
            if kind is not None:
                truth[kind] += f
        cases.append((len(atoms), pairs, features, truth))
    if not any(c[3].any() for c in cases):
        return weights
    past = np.zeros_like(weights)
    for _ in range(EPOCHS):
        for n, pairs, features, truth in cases:
            g = truth - expected(weights, n, pairs, features) - PENALTY * weights / len(cases)
            past += g * g
            weights += RATE * 5 * g / np.sqrt(past + 1e-6)
    return weights


def all_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """``(base spans, base and added spans)``, both sorted by start, then kind."""
    base = base_spans(text)
    added, k = [], 0
    ordered = sorted(base)
    for start, end in windows(text) if "@" in text or _HINT.search(text) else ():
        while k < len(ordered) and ordered[k][2] <= start:
            k += 1
        near = [s for s in ordered[k:k + MOST_ATOMS + (end - start)] if s[0] < end and s[2] > start]
        atoms, pairs, features = lattice(text, start, end, near)
        added += [(atoms[i][0], kind, atoms[j - 1][1]) for i, j, kind in best_segments(weights, len(atoms), pairs, features)]
    return base, sorted(base + added)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights from windows of at most ``SAMPLE_DOCS`` documents, chosen by a hash of the key.

    Only their windows, ``SAMPLE_WINDOWS`` at most, come to the driver.
    """
    ids = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key")).orderBy(
        F.xxhash64("key"), "key").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [t[a:b] for t in batch.column("text").to_pylist() for a, b in windows(t) if b - a <= 4 * SAMPLE_ATOMS]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], ["window"])

    made = rows.select("text").mapInArrow(run, "window string").distinct()
    picked = [r.window for r in made.orderBy(F.xxhash64("window"), "window").limit(SAMPLE_WINDOWS).collect()]
    return fit([w for w in picked if len(_ATOM.findall(w)) <= SAMPLE_ATOMS])


def find_private(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, spans)`` per row: base spans, and all spans, as arrays of (kind, start, end) in code points.

    NULL and empty texts have none. Texts are searched whole; work grows with their length.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [all_spans(t or "", weights) for t in part.column("text").to_pylist()]
            lists = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("key"), *lists], ["key", "base", "spans"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    key_kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {key_kind}, base {spans}, spans {spans}").withColumnRenamed("key", key)


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_private(docs, train(docs))
    kinds = F.col("base.kind")
    counts = [F.coalesce(F.size(kinds) - F.size(F.array_remove(kinds, k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
