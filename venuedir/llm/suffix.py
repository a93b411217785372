"""Exact substring dedup by bucket-pointer refinement over sampled suffixes.

Every byte that lies in a 400-byte string which also starts elsewhere is removed. Suffixes
are put into buckets by their first 100 bytes and buckets are refined by the bucket
identifiers of later offsets, 100 and then 200 bytes on, so that identifiers found once serve the
next, twice as deep step. An identifier is a hash of the bytes it stands for, so that refining needs no
lookup in other tasks; only bucket sizes are shared, and buckets of one suffix drop out.

Not every suffix enters. Each start of a 400-byte string is answered for by the suffix with the least
100-byte bucket among the 301 that begin in the string: equal strings choose equal suffixes, at equal distances.
The chosen suffix (about one in 150) carries its run of starts. Runs whose whole segment repeats are decided at
once; of the others, those whose bucket also holds other segments are cut into blocks of 50 starts with a bucket of
their own, the 351 bytes that all strings of the block share. What is still undecided is refined start by start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import mix, prefix_hash, run_hash, slices, staged, table, utf8
from venuedir.operators.skew import lookup

LENGTH, GRAM, BLOCK = 400, 100, 50
#: What a text's ranges belong to: its key and the hashes of its whole text.
_OWNER = ["key", "f1", "f2"]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if have < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Chosen suffixes of every text: row, first and last start they answer for, place, bucket, segment hashes.

    Positions count from the text's begin. Ties go to the leftmost suffix, so that periodic texts choose alike.
    """
    first, second = prefix_hash(data, 0), prefix_hash(data, 1)
    spot = np.arange(max(len(data) - gram + 1, 0))
    bucket = run_hash(first, spot, spot + gram)
    found: dict[str, list] = {"row": [], "lo": [], "hi": [], "at": [], "gram": [], "s1": [], "s2": []}
    bits = np.uint64(max(len(data), 2).bit_length())
    tagged = (bucket >> bits << bits) | spot.astype(np.uint64)
    for row in np.flatnonzero(np.diff(offsets) >= length):
        a, b = offsets[row], offsets[row + 1]
        chosen = (_sliding_least(tagged[a:b - gram + 1], length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        tails = np.append(heads[1:], len(chosen)) - 1
        found["row"].append(np.full(len(heads), row))
        found["lo"].append(heads)
        found["hi"].append(tails)
        found["at"].append(chosen[heads] - a)
        found["gram"].append(bucket[chosen[heads]])
        for name, prefix, which in (("s1", first, 0), ("s2", second, 1)):
            found[name].append(run_hash(prefix, a + heads, a + tails + length, which))
    empty = dict.fromkeys(("row", "lo", "hi", "at"), np.int64)
    return {k: np.concatenate(v) if v else np.zeros(0, empty.get(k, np.uint64)) for k, v in found.items()}


def refined(data: np.ndarray, length: int, gram: int, which: int) -> np.ndarray:
    """Bucket identifiers at depth ``length`` of all starts: buckets refined by those of later offsets."""
    prefix = prefix_hash(data, which)
    spot = np.arange(max(len(data) - gram + 1, 0))
    bucket = run_hash(prefix, spot, spot + gram, which)
    depth = gram
    while depth < length:
        step = min(depth, length - depth)  # the last step may overlap
        bucket = mix(bucket[: len(bucket) - step] * np.uint64(3) + mix(bucket[step:] + np.uint64(depth)))
        depth += step
    return bucket


def _identified(docs: DataFrame) -> DataFrame:
    """``docs(key, text)`` with two hashes of each whole text, ``f1`` and ``f2``."""
    return docs.select("key", F.coalesce("text", F.lit("")).alias("text")).select(
        "key", F.xxhash64("text").alias("f1"), F.xxhash64(F.lit(7), "text").alias("f2"), "text")


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, f1, f2, lo, hi, at, gram, s1, s2)``: one row per chosen suffix of every text."""
    names = ["key", "f1", "f2", "lo", "hi", "at", "gram", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            got = anchors(data, offsets, length, gram)
            row = got["row"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(pa.array(row)) for c in _OWNER],
                 *[pa.array(got[c].astype(np.int32)) for c in names[3:6]],
                 *[pa.array(got[c].view(np.int64)) for c in names[6:]]], names)

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, f1 long, f2 long, lo int, hi int, at int, gram long, s1 long, s2 long")


def _settled(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(repeated, open)`` of ``found(key, f1, f2, lo, hi, at, gram, s1, s2, undecided)``.

    ``repeated`` holds the hashes of segments that occur more than once. ``open`` are the others that share
    a bucket with a different segment, and one occurrence of each repeated segment in such a bucket.
    """
    kinds = found.groupBy("s1", "s2").agg(
        F.count("*").alias("n"), F.first("gram").alias("gram"),
        F.min(F.struct("key", "f1", "f2", "lo", "hi", "at", "undecided")).alias("one"))
    kinds = staged(kinds, name)
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    opened = lookup(kinds, mixed, ["gram"], "inner").withColumn("undecided", F.col("one.undecided") & (F.col("n") == 1))
    return kinds.where("n > 1").select("s1", "s2"), opened.select(
        *[F.col(f"one.{c}").alias(c) for c in ("key", "f1", "f2", "lo", "hi", "at")], "undecided")


_RANGE = ["lo", "hi", "at", "undecided"]


def _same_owner() -> Column:
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _OWNER]
    return (F.col("_own") == F.col("_hash")) & same[0] & same[1] & same[2]


def _listed(texts: DataFrame, ranges: DataFrame, fields: list[str], how: str) -> DataFrame:
    """``(key, f1, f2, text, ranges)``: to every row the distinct ranges of its key and text.

    Ranges of one key and text are bounded by the text, however many rows repeat both or have no key. The hash of
    the three joins along, so that the join lies directly between two shuffles and rows that repeat are split.
    """
    ranges = ranges.groupBy(*_OWNER).agg(F.collect_set(F.struct(*fields)).alias("ranges"))
    right = ranges.select(*[F.col(c).alias(f"_{c}") for c in _OWNER], "ranges", F.xxhash64(*_OWNER).alias("_hash"))
    joined = texts.withColumn("_own", F.xxhash64(*_OWNER)).join(right, _same_owner(), how)
    none = F.expr("array()").cast(ranges.schema["ranges"].dataType)
    return joined.select(*_OWNER, "text", F.coalesce("ranges", none).alias("ranges"))


def _unpacked(part: pa.RecordBatch, names: list[str]) -> tuple:
    """``(bytes, offsets, row of each range, fields)`` of a batch of :func:`_listed`."""
    data, offsets = utf8(part.column("text"))
    listed = part.column("ranges")
    bounds = listed.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(listed)), np.diff(bounds))
    inner = listed.values.slice(bounds[0], bounds[-1] - bounds[0])
    return data, offsets, row, {c: inner.field(c).to_numpy(zero_copy_only=False) for c in names}


def blocks(texts: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """Open ranges cut into blocks of starts at fixed distances from the chosen suffix; columns of :func:`segments`."""
    names = ["key", "f1", "f2", "lo", "hi", "at", "gram", "s1", "s2", "undecided"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets, row, got = _unpacked(part, _RANGE)
            near, far = got["at"] - got["hi"], got["at"] - got["lo"]
            n = far // BLOCK - near // BLOCK + 1
            of = np.repeat(np.arange(len(row)), n)
            k = (near // BLOCK)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at, row = got["at"][of].astype(np.int64), row[of]
            lo = at - np.minimum(far[of], BLOCK * k + BLOCK - 1)
            hi = at - np.maximum(near[of], BLOCK * k)
            base = offsets[row]
            first, second = prefix_hash(data, 0), prefix_hash(data, 1)
            core = base + at - BLOCK * k
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(pa.array(row)) for c in _OWNER],
                 *[pa.array(x.astype(np.int32)) for x in (lo, hi, at)],
                 pa.array(run_hash(first, core, core + length - BLOCK + 1).view(np.int64)),
                 pa.array(run_hash(first, base + lo, base + hi + length).view(np.int64)),
                 pa.array(run_hash(second, base + lo, base + hi + length, 1).view(np.int64)),
                 pa.array(got["undecided"][of])], names)

    kind = texts.schema["key"].dataType.simpleString()
    return _listed(texts, opened, _RANGE, "inner").mapInArrow(run, f"key {kind}, f1 long, f2 long, lo int, hi int, at int, gram long, s1 long, "
                                                  "s2 long, undecided boolean")


def starts(texts: DataFrame, opened: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, f1, f2, lo, w1, w2, undecided)``: every start of the open ranges with its refined bucket."""
    names = ["key", "f1", "f2", "lo", "w1", "w2", "undecided"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets, row, got = _unpacked(part, _RANGE)
            n = (got["hi"] - got["lo"] + 1).astype(np.int64)
            of = np.repeat(np.arange(len(row)), n)
            lo = got["lo"][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            row = row[of]
            ids = [refined(data, length, gram, k)[offsets[row] + lo].view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(pa.array(row)) for c in _OWNER], pa.array(lo.astype(np.int32)),
                 pa.array(ids[0]), pa.array(ids[1]), pa.array(got["undecided"][of])], names)

    kind = texts.schema["key"].dataType.simpleString()
    return _listed(texts, opened, _RANGE, "inner").mapInArrow(
        run, f"key {kind}, f1 long, f2 long, lo int, w1 long, w2 long, undecided boolean")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, f1, f2, a, b)``: byte ranges that together cover the repeated strings of ``docs(key, text)``."""
    docs = _identified(docs)
    found = segments(docs, length, gram)
    often = found.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    common = staged(lookup(found, often, ["gram"], "inner").withColumn("undecided", F.lit(True)), "suffixes")
    repeated, opened = _settled(common, "segments")
    opened = staged(opened, "open")
    owners = opened.select(*[F.col(c).alias(f"_{c}") for c in _OWNER]).distinct()
    texts = staged(docs.withColumn("_own", F.xxhash64(*_OWNER)).join(
        owners.withColumn("_hash", F.xxhash64(*owners.columns)), _same_owner(), "left_semi").drop("_own"), "texts")
    cut = staged(blocks(texts, opened, length), "blocks")
    again, rest = _settled(cut, "segments")
    spots = staged(starts(texts, staged(rest, "open"), length, gram), "starts")
    twice = spots.groupBy("w1", "w2").agg(F.count("*").alias("m")).where("m > 1").select("w1", "w2")

    def covered(rows: DataFrame, last: str) -> DataFrame:
        return rows.select("key", "f1", "f2", F.col("lo").alias("a"), (F.col(last) + length).alias("b"))

    return (covered(common.join(repeated, ["s1", "s2"]), "hi")
            .union(covered(cut.where("undecided").join(again, ["s1", "s2"]), "hi"))
            .union(covered(lookup(spots.where("undecided"), twice, ["w1", "w2"], "inner"), "lo")))


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, n_bytes, spans, kept)`` per row: removed byte spans and the bytes that stay.

    A byte goes if a string of ``length`` bytes around it starts at two places of the corpus, in the same row
    or another; overlapping occurrences count, copies of a whole text too, and all is judged on the input. Matches never
    cross rows; texts shorter than ``length`` and NULL texts (empty) lose nothing. Rows may share a key or have none.
    """
    if not 0 < gram <= length - BLOCK:
        raise ValueError("gram must be positive and leave room for a block")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    joined = _listed(_identified(rows), repeated_ranges(rows, length, gram), ["a", "b"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets, row, got = _unpacked(part, ["a", "b"])
            order = np.lexsort((got["a"], row))
            row, a, b = row[order], got["a"][order].astype(np.int64), got["b"][order].astype(np.int64)
            reach = np.maximum.accumulate(b + offsets[row]) if len(row) else b  # offsets grow by row
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (a[1:] + offsets[row[1:]] > reach[:-1])
            heads = np.flatnonzero(new)
            begin = a[heads]
            end = reach[np.append(heads[1:], len(row)) - 1] - offsets[row[heads]] if len(heads) else b
            bounds = np.searchsorted(row[heads], np.arange(part.num_rows + 1))
            spans, kept = [], []
            for i in range(part.num_rows):
                own = slice(bounds[i], bounds[i + 1])
                spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(begin[own], end[own], strict=True)])
                raw = data[offsets[i]:offsets[i + 1]]
                edges = [0, *np.column_stack([begin[own], end[own]]).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["key", "n_bytes", "spans", "kept"])

    kind = rows.schema["key"].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
                             ).withColumnRenamed("key", key)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes, removed runs and the SHA-256 of the rest, for every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
