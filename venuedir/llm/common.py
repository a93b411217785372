"""Shared folders, stages on storage, connected components, Arrow text as bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.operators.skew import lookup

#: Python tasks take texts in slices of about this many bytes, so that their arrays stay small.
SLICE_BYTES = 2_000_000
#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing, a local session gets a temporary folder; a cluster
    has to name one, because its machines share no local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="llm-"))
        base = _OWN[0]
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage on storage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """Column names that clash with none of ``taken`` (Spark compares without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Words of a text (NULL: 0) as long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- connected components -----------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every node of ``edges(u, v)``: the least node it is linked with.

    Large-star and small-star steps, each a few joins and combining aggregates; the hub of a star may
    hold any share of the edges, as its side of the join is one that Spark splits. Edges
    are written to the shared folder after every round, so a lost executor costs one
    round; the driver sees two numbers a round. Self links count as nodes; NULLs are dropped.
    """
    nodes = edges.where("u is not null and v is not null")
    links = staged(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")
    before = None
    while True:
        mark = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
                         F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        if mark[0] == 0 or tuple(mark) == before:
            break
        before = tuple(mark)
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = lookup(both.where("v > u"), least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = staged(small, "edges")
    roots = nodes.select("u").union(nodes.select("v")).distinct()
    return roots.join(links, "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component_id"))


# --- Arrow text as bytes ------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column, NULL as empty; no Python strings are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
                          .to_numpy(zero_copy_only=False).astype(np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


# --- hashes of byte runs ------------------------------------------------------

# Odd multipliers and the finaliser below are arbitrary fixed 64-bit constants.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEED = 20_240_117


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, up to ``n``."""
    got = _POWERS.get(which)
    if got is None or len(got[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        base = _BASES[which]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(b)
            pair.append(np.multiply.accumulate(out))
        got = _POWERS[which] = (pair[0], pair[1])
    return got


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which :func:`run_hash` reads the hash of any byte run."""
    codes = np.random.default_rng(_SEED + which).integers(1, 1 << 63, 256, dtype=np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _powers(which, len(data))[0][: len(data)], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the runs ``[start, end)``; equal bytes have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _powers(which, len(prefix))[1][start])


# --- word runs of byte texts --------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of all words; words never cross rows."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SPACE[data]
    solid = ~gap
    head = solid.copy()
    head[1:] &= gap[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    head[firsts] = solid[firsts]
    tail = solid.copy()
    tail[:-1] &= gap[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    tail[lasts] = solid[lasts]
    start = np.flatnonzero(head)
    end = np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return _LOWER[data]
