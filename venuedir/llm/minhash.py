"""Near-duplicates by an inverted join of MinHash signature coordinates.

Each distinct shingle set posts itself under the (coordinate, value) pairs of its signature.
Pairs are ranked by how many sets post them, and two sets that agree in ``MATCHES``
coordinates share one of their ``COORDINATES - MATCHES + 1`` rarest pairs: only that prefix is
merged, frequent postings are skipped. Merging counts agreeing coordinates and keeps what
reaches the threshold; kept pairs are joined to clusters, and inside a cluster full sets
confirm every link that could still join two components.

Copies (equal sets) collapse to one row first, so a group of copies costs nothing. Postings
and clusters of any size are cut into blocks that meet pairwise in separate tasks; a task
holds two blocks and emits at most one link per member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import components, fresh, lowered, mix, prefix_hash, run_hash, slices, staged, table, utf8, word_runs

#: At a similarity of 0.8 a pair misses the match threshold with probability 2e-7, above it less.
COORDINATES, MATCHES = 20, 6
PERCENT = 80
#: Members of a block, and shingles of a block's sets.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000
#: Bytes of marks compared at once.
MARK_BYTES = 4_000_000
_SALTS = np.random.default_rng(77).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: per text the sorted distinct 64-bit hashes of its word shingles."""
    text = lowered(data)
    start, end, row = word_runs(text, offsets)
    word = run_hash(prefix_hash(text), start, end)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    left = counts[row] - (np.arange(len(row)) - first[row])  # words from here to the text's end
    short = counts[row] < words
    value = np.zeros(len(row), np.uint64)
    for k in range(words):
        inside = np.flatnonzero(left > k)
        value[inside] = mix(value[inside] + word[inside + k] + np.uint64(k + 1))
    at = np.flatnonzero((left >= words) | short & (left == counts[row]))
    value, row = value[at], row[at]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(n + 1))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``(texts, coordinates)``: least scrambled hash per coordinate; rows of empty sets are zero."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for c in range(COORDINATES):
            out[full, c] = np.minimum.reduceat(mix(value ^ _SALTS[c]), bounds[full])
    return out


def _sums(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit fingerprints of each set."""
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ salt), dtype=np.uint64)])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def describe(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``(key, n, f1, f2, sig)``: set size, fingerprints and signature of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            value, bounds = shingle_sets(*utf8(part.column("text")), words)
            f1, f2 = _sums(value, bounds)
            sig = signatures(value, bounds).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES),
                                              pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(np.diff(bounds), pa.int64()), pa.array(f1), pa.array(f2), listed],
                ["key", "n", "f1", "f2", "sig"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n long, f1 long, f2 long, sig array<long>")


def _in_blocks(rows: DataFrame, group: list[str], blocks: F.Column) -> DataFrame:
    """Rows dealt out by ``(group, b1, b2)`` and sorted by it: every pair of a group's rows meets somewhere.

    ``blocks`` is the number of blocks of a row's group. A group of one block is in one place; otherwise a row
    goes to each pair of blocks that holds its own.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = rows.withColumn("_blocks", F.greatest(blocks.cast("long"), F.lit(1))).withColumn("_own", own).select(
        "*", other.alias("_other")).where("_blocks = 1 or _own <> _other")
    dealt = dealt.withColumns({"b1": F.least("_own", "_other"), "b2": F.greatest("_own", "_other")})
    return (dealt.drop("_blocks", "_own", "_other").repartition(*group, "b1", "b2")
            .sortWithinPartitions(*group, "b1", "b2", "rep"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows: ``(rows, group bounds)``; the last group of a batch waits for the next."""
    waiting: list[pa.RecordBatch] = []

    def changes(rows: pa.Table) -> np.ndarray:
        new = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in keys:
            x = rows.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and all(waiting[-1].column(k)[-1] == batch.column(k)[-1] for k in keys):
            waiting.append(batch)
            continue
        rows = pa.Table.from_batches([*waiting, batch])
        cut = changes(rows)
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield rows.slice(0, last), np.concatenate([[0], cut])
        waiting = rows.slice(last).to_batches()
    if waiting:
        rows = pa.Table.from_batches(waiting)
        yield rows, np.concatenate([[0], changes(rows), [rows.num_rows]])


def spanning_links(sig: np.ndarray, size: np.ndarray, bounds: np.ndarray, percent: int,
                   confirm: Callable[[int, int], bool] | None = None,
                   possible: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs ``(left, right)`` that span each group's links: every row with the first row it is linked with.

    A pair counts if enough coordinates agree, its sizes allow the similarity and ``confirm``
    (where given) holds; ``possible`` may rule out pairs before that, many at a time. Pairs inside one
    component are skipped, and a component of m rows gives m - 1 pairs, a star around its first row, so that
    joining the components of all groups takes few rounds. Groups are compared side by side, one distance
    after the other.
    """
    label = np.arange(len(sig))
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[1:][group] - np.arange(len(sig))  # rows from here to the group's end
    live = np.flatnonzero(room > 1)
    step = 1
    while len(live):
        other = live + step
        fits = 100 * np.minimum(size[live], size[other]) >= percent * np.maximum(size[live], size[other])
        fits &= label[live] != label[other]
        a, b = live[fits], other[fits]
        same = (sig[a] == sig[b]).sum(1) >= MATCHES
        a, b = a[same], b[same]
        if possible is not None and len(a):
            may = possible(a, b)
            a, b = a[may], b[may]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if label[i] != label[j] and (confirm is None or confirm(i, j)):
                part = label[bounds[group[i]]:bounds[group[i] + 1]]
                low, high = sorted((label[i], label[j]))
                part[part == high] = low
        step += 1
        live = live[room[live] > step]
    right = np.flatnonzero(label != np.arange(len(label)))
    return label[right], right


def difference_bits(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``(sets, words)``: one bit per hashed shingle, some four bits for every shingle of the average set.

    Two sets differ in at least as many shingles as their rows differ in bits, whatever shares a bit.
    """
    sets = len(bounds) - 1
    mean = max(len(value) // max(sets, 1), 16)
    bits = 1 << int(4 * mean - 1).bit_length()
    row = np.repeat(np.arange(sets), np.diff(bounds))
    flags = np.zeros(sets * bits, bool)
    flags[row * bits + (mix(value) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags.reshape(sets, bits), axis=1).view(np.uint64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    listed = column.combine_chunks()
    listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
    return listed.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def candidate_links(classes: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: links that span the sets agreeing in ``MATCHES`` coordinates, from ``(rep, n, sig)``."""
    posts = classes.select("rep", F.posexplode("sig").alias("c", "value"))
    common = posts.groupBy("c", "value").agg(F.count("*").alias("f")).where("f > 1")
    shared = posts.join(common, ["c", "value"]).groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("f", "c", "value"))).alias("shared"))
    room = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("shared"))
    prefix = shared.where(room > 0).select("rep", F.explode(F.slice("shared", 1, room)).alias("p"))
    rows = prefix.join(classes, "rep").select("rep", "n", "sig", "p.c", "p.value", "p.f")
    rows = _in_blocks(rows, ["c", "value"], F.ceil(F.col("f") / BLOCK_ROWS)).select("c", "value", "b1", "b2", "rep", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in _runs(batches, ["c", "value", "b1", "b2"]):
            left, right = spanning_links(_matrix(part.column("sig")), part.column("n").to_numpy(), bounds, percent)
            rep = part.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(left)), rep.take(pa.array(right))], ["u", "v"])

    kind = classes.schema["rep"].dataType.simpleString()
    return rows.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def confirmed_links(docs: DataFrame, members: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``(u, v)``: links spanning what full sets confirm, among ``members(rep, cluster, n, f1, f2, sig)``.

    Texts are read again, only those of members are turned into sets, and a set travels to its cluster's blocks.
    """
    rows = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("text")).join(members, "rep")
    names = ["rep", "cluster", "n", "sig", "shingles"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            value, bounds = shingle_sets(*utf8(part.column("text")), words)
            f1, f2 = _sums(value, bounds)
            right = (f1 == part.column("f1").to_numpy()) & (f2 == part.column("f2").to_numpy())
            sets = pa.array([value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            made = pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-1]], sets], names)
            yield made.filter(pa.array(right))

    kind = members.schema["rep"].dataType.simpleString()
    sets = rows.select("rep", "text", "cluster", "n", "f1", "f2", "sig").mapInArrow(
        expand, f"rep {kind}, cluster {kind}, n long, sig array<long>, shingles binary")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("_rows"), F.sum("n").alias("_total"))
    blocks = F.greatest(F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_total") / BLOCK_SHINGLES))
    dealt = _in_blocks(sets.join(sizes, "cluster"), ["cluster"], blocks).select("cluster", "b1", "b2", *names[:1], *names[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in _runs(batches, ["cluster", "b1", "b2"]):
            n = part.column("n").to_numpy()
            raw = part.column("shingles")
            found: dict[int, np.ndarray] = {}
            flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
            marks = difference_bits(flat, np.concatenate([[0], np.cumsum(n)]))

            def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                united = n[a] + n[b]  # noqa: B023
                apart = np.empty(len(a), np.int64)
                width = max(1, MARK_BYTES // marks.shape[1] // 8)  # noqa: B023
                for k in range(0, len(a), width):
                    at = slice(k, k + width)
                    apart[at] = np.bitwise_count(marks[a[at]] ^ marks[b[at]]).sum(1, dtype=np.int64)  # noqa: B023
                return 100 * (united - apart) >= percent * (united + apart)

            def values(i: int) -> np.ndarray:
                if i not in found:
                    found[i] = np.frombuffer(raw[i].as_buffer(), np.uint64)  # noqa: B023
                return found[i]  # noqa: B023

            def confirm(i: int, j: int) -> bool:
                a, b = values(i), values(j)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                return 100 * both >= percent * (len(a) + len(b) - both)

            left, right = spanning_links(_matrix(part.column("sig")), n, bounds, percent, confirm, possible)
            rep = part.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(left)), rep.take(pa.array(right))], ["u", "v"])

    return dealt.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lowered. A text with fewer than ``words`` words is one
    shingle; without words (or NULL) its set is empty and it is linked with nothing. Two texts are linked when
    ``100 * common >= percent * united`` (``percent`` 80 or more), and a component is named after its smallest
    key. Rows with one key are one node; rows with a NULL key have no component and stay. No rows give no rows.
    """
    seen = staged(describe(docs, key, text, words), "signatures")
    full = seen.where("n > 0 and key is not null")
    classes = staged(full.groupBy("n", "f1", "f2").agg(F.min("key").alias("rep"), F.first("sig").alias("sig")), "classes")
    near = components(staged(candidate_links(classes, percent), "candidates"))
    members = classes.join(near.withColumnRenamed("id", "rep").withColumnRenamed("component_id", "cluster"), "rep")
    links = components(staged(confirmed_links(docs, staged(members, "members"), key, text, words, percent), "links"))
    named = seen.join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"], "left").join(
        links.withColumnRenamed("id", "rep"), "rep", "left")
    own = F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.coalesce("component_id", "rep")).otherwise(F.col("key"))
    out = named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component; columns stay."""
    (other,) = fresh(docs.columns, "_gone")
    gone = near_duplicates(docs, words, percent, key, text).where("not kept").select(F.col(key).alias(other)).distinct()
    return docs.join(gone, F.col(key) == F.col(other), "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents over two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
