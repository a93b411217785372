"""Near-duplicate embeddings by robust-pruned graphs over overlapping cluster shards.

Vectors go to their nearest centroids, several each, so that shards overlap. Every shard builds
a graph whose edges are pruned robustly; the adjacency lists of a vector are united over its shards.
A search starts at a block's medoid, at an entry of every group of near-copies and at the query itself if the
block holds it, walks greedily, and once inside the range expands every vector in range.
Found pairs are verified in double precision; an audit compares a bounded set of vectors with all
others. Where recall is short, blocks are compared exactly, then the overlap is widened; a result that stays short is an error.

Equal vectors collapse to one first. A shard of any size is cut into blocks that build and hold their
own graph; its vectors search every block. Tasks return one row per query and block, never pairs: found links are
bits over the places of a block, which are united over shards and searches and then counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import components, staged, table

COSINE = 0.95
#: Vectors that the centroids are fitted on, vectors per shard wanted, and most shards.
SAMPLE, SHARD_ROWS, MOST_SHARDS = 20_000, 700, 1024
#: Vectors of a block at most (on average), homes of a vector, pool and degree of a graph, slack of its pruning.
BLOCK_ROWS, HOMES, POOL, DEGREE, SLACK = 1024, 3, 48, 16, 1.2
#: Width of the greedy search; vectors the audit compares with all; the recall it wants.
BEAM, AUDIT, RECALL = 24, 200, 0.95
#: Vectors with links that the audit wants to see, and most vectors it draws for that.
AUDIT_LINKED, AUDIT_MOST = 50, 6_200


def usable(vector: Column) -> Column:
    """Neither NULL nor empty nor zero, and all parts are finite numbers."""
    parts = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & parts & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    listed = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return listed.flatten().to_numpy(zero_copy_only=False).reshape(len(listed), -1)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the driver over the bounded sample."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def robust_prune(x: np.ndarray, pool: np.ndarray, sims: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Neighbours of every row out of its pool (nearest first): -1 pads.

    The nearest is taken, and pool members that lie closer to it, by ``slack``, than to the row are
    dropped; and so on. All rows step together.
    """
    n = len(x)
    alive = pool >= 0
    out = np.full((n, degree), -1)
    far = np.sqrt(np.maximum(2 - 2 * sims, 0))
    for d in range(degree):
        any_left = alive.any(1)
        if not any_left.any():
            break
        first = alive.argmax(1)
        pick = pool[np.arange(n), first]
        out[any_left, d] = pick[any_left]
        between = np.einsum("npd,nd->np", x[pool], x[pick])
        covered = slack * np.sqrt(np.maximum(2 - 2 * between, 0)) <= far
        alive &= ~covered
        alive[np.arange(n), first] = False
    return out


def build_graph(x: np.ndarray) -> np.ndarray:
    """Pruned adjacency of a block: pools of nearest rows, pruned, reverse edges added, pruned again."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    x = x.astype(np.float32)
    take = min(POOL, n - 1)

    def pruned(pool: np.ndarray) -> np.ndarray:
        sims = np.where(pool >= 0, np.einsum("npd,nd->np", x[pool], x), -2)
        order = np.argsort(-sims, 1, kind="stable")[:, :POOL]
        pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
        return robust_prune(x, pool, sims, DEGREE, SLACK)

    pool = np.empty((n, take), np.int64)
    for a in range(0, n, 512):
        sims = x[a:a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        pool[a:a + 512] = np.argpartition(-sims, take - 1, 1)[:, :take]
    graph = pruned(pool)
    row, slot = np.nonzero(graph >= 0)
    target = graph[row, slot]
    order = np.argsort(target, kind="stable")
    target, source = target[order], row[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    inside = rank < POOL
    back = np.full((n, POOL), -1)
    back[target[inside], rank[inside]] = source[inside]
    back[(back[:, :, None] == graph[:, None, :]).any(2)] = -1
    return pruned(np.concatenate([graph, back], 1))


def entries(x: np.ndarray, graph: np.ndarray, cosine: float, foreign: bool = True) -> np.ndarray:
    """The medoid of a block and the rows that searches need to start at besides; the degree cut does not touch them.

    One for every part that edges in range hold together, so that a group of near-copies has an entry of its own;
    one for whatever no path leads to then; and, if ``foreign`` queries come, rows that a search for themselves misses.
    """
    x = x.astype(np.float32)
    bound = cosine - 1e-4
    row, slot = np.nonzero(graph >= 0)
    target = graph[row, slot]
    near = np.einsum("nd,nd->n", x[row], x[target]) >= bound
    every: list[list[int]] = [[] for _ in x]
    close: list[list[int]] = [[] for _ in x]
    for a, b, c in zip(row.tolist(), target.tolist(), near.tolist(), strict=True):
        every[a].append(b)
        if c:
            close[a].append(b)
    chosen = [int((x @ x.mean(0)).argmax())]

    def join(edges: list[list[int]], wanted: list[int]) -> None:
        reached, todo = set(chosen), list(chosen)
        for k in [None, *wanted]:
            if k is not None and k not in reached:
                chosen.append(k)
                reached.add(k)
                todo.append(k)
            while todo:
                new = [b for b in edges[todo.pop()] if b not in reached]
                reached.update(new)
                todo.extend(new)

    join(close, [a for a, b in enumerate(close) if b])
    join(every, list(range(len(x))))
    if foreign:
        alone = np.setdiff1d(np.arange(len(x)), np.concatenate([row[near], target[near], chosen]))
        if len(alone):
            hit = _walk(x[alone], x, graph, bound, np.array(chosen), alone[:0])[np.arange(len(alone)), alone] >= bound
            chosen.extend(alone[~hit].tolist())
    return np.array(chosen)


def _walk(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, bound: float, start: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The cosine of every query with every row it has seen, -2 with others.

    Each step expands, for every query, its best row not yet expanded, as long as that row is among the
    ``BEAM`` best seen or in range; where many are in range, all of these at once.
    """
    linked = np.zeros((len(x), len(x)), np.float32)
    row, slot = np.nonzero(graph >= 0)
    linked[row, graph[row, slot]] = 1
    seen = np.full((len(queries), len(x)), -2, np.float32)
    seen[:, start] = queries @ x[start].T
    seen[np.arange(len(own)), own] = np.einsum("nd,nd->n", queries[:len(own)], x[own])
    open_ = seen.copy()
    live = np.arange(len(queries))
    beam = min(BEAM, len(x))
    while len(live):
        ready = open_[live] >= bound
        if ready.sum() > 4 * len(live):
            some = ready.any(1)
            at, ready = live[some], ready[some]
            open_[at] = np.where(ready, -2, open_[at])
            q, target = np.nonzero((ready.astype(np.float32) @ linked > 0) & (seen[at] == -2))
            for a in range(0, len(q), 100_000):
                rows, to = at[q[a:a + 100_000]], target[a:a + 100_000]
                seen[rows, to] = open_[rows, to] = np.einsum("nd,nd->n", queries[rows], x[to])
            continue
        best = open_[live].argmax(1)
        value = open_[live, best]
        edge = np.partition(seen[live], len(x) - beam, 1)[:, len(x) - beam]
        go = (value > -2) & ((value >= edge) | (value >= bound))
        live, best = live[go], best[go]
        open_[live, best] = -2
        near = graph[best]
        q, slot = np.nonzero(near >= 0)
        rows, target = live[q], near[q, slot]
        new = seen[rows, target] == -2
        rows, target = rows[new], target[new]
        sims = np.einsum("nd,nd->n", queries[rows], x[target])
        seen[rows, target] = sims
        open_[rows, target] = sims
    return seen


def range_search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, cosine: float,
                 own: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(query, row)`` pairs whose cosine may reach ``cosine``, by greedy search from the block's :func:`entries`.

    The first ``len(own)`` queries are these rows of the block and start there too.
    """
    own = np.zeros(0, np.int64) if own is None else own
    start = entries(x, graph, cosine, len(own) < len(queries)) if start is None else start
    bound = cosine - 1e-4
    return np.nonzero(_walk(queries.astype(np.float32), x.astype(np.float32), graph, bound, start, own) >= bound)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one group after the other, from sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        mark = np.column_stack([rows.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1).tolist(), len(mark)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            now = tuple(mark[a].tolist())
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            last = now
            held.append(rows.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _homes(vectors: DataFrame, centres: np.ndarray, homes: int) -> DataFrame:
    """``(shard, rep, vec, copies)``: every vector once for each of its nearest centroids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(_unit(_matrix(batch.column("vec"))) @ centres.T), 1, kind="stable")[:, :homes]
            n, h = near.shape
            own = pa.array(np.repeat(np.arange(n), h))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *[batch.column(c).take(own) for c in ("rep", "vec", "copies")]],
                                             ["shard", "rep", "vec", "copies"])

    return vectors.select("rep", "vec", "copies").mapInArrow(run, "shard long, rep long, vec array<double>, copies long")


def _adjacency(placed: DataFrame) -> DataFrame:
    """``(rep, near, spots)``: united adjacency lists of the graphs of all blocks, and the places in them by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["shard", "block"]):
            graph = build_graph(_unit(_matrix(rows.column("vec"))))
            rep = rows.column("rep").to_numpy()
            near = [rep[g[g >= 0]] for g in graph]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep), pa.array(near, pa.list_(pa.int64())), rows.column("shard").combine_chunks(),
                 rows.column("block").combine_chunks(), pa.array(np.arange(len(rep)))], ["rep", "near", "shard", "block", "pos"])

    rows = placed.select("shard", "block", "rep", "vec").repartition("shard", "block").sortWithinPartitions("shard", "block", "rep")
    return rows.mapInArrow(run, "rep long, near array<long>, shard long, block long, pos long").groupBy("rep").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
        F.array_sort(F.collect_list(F.struct("shard", "block", "pos"))).alias("spots"))


def _marks(q: np.ndarray, v: np.ndarray, spots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``(row, shard, block, bits)``: which places of a block a row is linked with, one bit each.

    The block is that of ``v`` in the first shard that both live in, so that all shards that find a pair set one bit.
    """
    shards, blocks, places = spots
    first = np.full(len(q), np.iinfo(np.int64).max)
    for h in range(shards.shape[1]):
        mine = shards[q, h]
        first = np.where((shards[v] == mine[:, None]).any(1), np.minimum(first, mine), first)
    slot = (shards[v] == first[:, None]).argmax(1)
    block, place = blocks[v, slot], places[v, slot]
    order = np.lexsort((block, first, q))
    q, first, block, place = q[order], first[order], block[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (first[1:] != first[:-1]) | (block[1:] != block[:-1])]))
    group = np.repeat(np.arange(len(head)), np.diff([*head, len(q)]))
    ends = np.concatenate([[0], np.cumsum(np.maximum.reduceat(place, head) // 8 + 1)])
    raw = np.bincount(ends[group] + place // 8, 1 << (place % 8), ends[-1]).astype(np.uint8)
    bits = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
    return q[head], first[head], block[head], bits


def _search(placed: DataFrame, graph: DataFrame, cosine: float, exact: bool = False) -> DataFrame:
    """Links as ``(u, v)`` per query and block, a vector that ``u`` is linked with, and as :func:`_marks` for counting.

    Links hold both ways, whoever found them. ``exact`` compares all rows of a block.
    """
    held = placed.join(graph, "rep").select(
        "shard", "block", "blocks", "rep", "vec", "near", *[F.col(f"spots.{c}").alias(f"{c}s") for c in ("shard", "block", "pos")])
    about = ["rep", "vec", "shards", F.col("blocks_").alias("blocks"), "poss"]
    held = held.toDF(*["shard", "block", "many", "rep", "vec", "near", "shards", "blocks_", "poss"])
    data = held.select("shard", "block", F.lit(0).alias("asks"), *about, "near")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))
    asking = held.withColumn("to", other).where("to <> block").select(
        "shard", F.col("to").alias("block"), F.lit(1).alias("asks"), *about, F.lit(None).cast("array<long>").alias("near"))
    rows = data.union(asking).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["shard", "block"]):
            asks = group.column("asks").to_numpy()
            m = int((asks == 0).sum())
            if not m:
                continue
            rep = group.column("rep").to_numpy()
            unit = _unit(_matrix(group.column("vec")))
            spots = [_matrix(group.column(c)) for c in ("shards", "blocks", "poss")]
            near = group.column("near").slice(0, m).to_pylist()
            graph = np.full((m, max(1, *[len(x) for x in near])), -1)
            for i, listed in enumerate(near):
                at = np.searchsorted(rep[:m], listed)
                at = at[(at < m) & (rep[np.minimum(at, m - 1)] == listed)]
                graph[i, : len(at)] = at
            label = np.arange(len(unit))
            start = None if exact else entries(unit[:m], graph, cosine, m < len(unit))
            for a in range(0, len(unit), BLOCK_ROWS):  # bounds the table of what each query has seen
                if exact:
                    q, v = np.nonzero(unit[a:a + BLOCK_ROWS] @ unit[:m].T >= cosine - 1e-4)
                else:
                    own = np.arange(a, max(a, min(a + BLOCK_ROWS, m)))
                    q, v = range_search(unit[a:a + BLOCK_ROWS], unit[:m], graph, cosine, own, start)
                q = q + a
                other = q != v
                q, v = q[other], v[other]
                real = np.zeros(len(q), bool)
                for b in range(0, len(q), 50_000):
                    real[b:b + 50_000] = np.einsum("nd,nd->n", unit[q[b:b + 50_000]], unit[v[b:b + 50_000]]) >= cosine
                q, v = q[real], v[real]
                if not len(q):
                    continue
                while True:  # least row reachable inside this group
                    x, y = label[q], label[v]
                    if (x == y).all():
                        break
                    np.minimum.at(label, x, y)
                    np.minimum.at(label, y, x)
                    while (label[label] != label).any():
                        label = label[label]
                pairs = np.unique(np.concatenate([q * len(unit) + v, v * len(unit) + q]))
                row, *where = _marks(pairs // len(unit), pairs % len(unit), spots)
                yield pa.RecordBatch.from_arrays([pa.array(rep[row]), pa.nulls(len(row), pa.int64()), *map(pa.array, where)],
                                                 ["u", "v", "shard", "block", "bits"])
            none = pa.nulls(len(rep), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rep[label]), none, none, pa.nulls(len(rep), pa.binary())],
                                             ["u", "v", "shard", "block", "bits"])

    return rows.mapInArrow(run, "u long, v long, shard long, block long, bits binary")


def _counts(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``(u, n)``: rows that ``u`` is linked with, every pair once however many shards found it."""
    marks = links.where("bits is not null").select("shard", "block", F.lit(1).alias("kind"), "u", F.lit(0).cast("long").alias("n"), "bits")
    held = placed.select("shard", "block", F.lit(0).alias("kind"), F.col("rep").alias("u"), F.col("copies").alias("n"),
                         F.lit(None).cast("binary").alias("bits"))
    rows = held.union(marks).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["shard", "block"]):
            m = int((group.column("kind").to_numpy() == 0).sum())
            copies = group.column("n").to_numpy()[:m].astype(np.float64)
            u = group.column("u").to_numpy()[m:]
            if not len(u):
                continue
            bits = group.column("bits").slice(m).cast(pa.large_binary()).combine_chunks()
            _, ends, raw = bits.buffers()
            ends = np.frombuffer(ends, np.int64, len(bits) + 1, bits.offset * 8)
            row = np.repeat(np.arange(len(u)), np.diff(ends))
            table_ = np.zeros((len(u), (m + 7) // 8), np.uint8)
            table_[row, np.arange(ends[0], ends[-1]) - ends[row]] = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]]
            head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            table_ = np.bitwise_or.reduceat(table_, head, 0)
            n = np.zeros(len(head), np.int64)
            for a in range(0, len(head), 1000):
                n[a:a + 1000] = np.rint(np.unpackbits(table_[a:a + 1000], 1, m, "little") @ copies)
            yield pa.RecordBatch.from_arrays([pa.array(u[head]), pa.array(n)], ["u", "n"])

    return rows.mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))


def true_links(vectors: DataFrame, asked: np.ndarray, cosine: float) -> DataFrame:
    """``(q, copies)``: rows that reach ``cosine`` with the given unit vectors, by comparing with all; to be summed by ``q``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                near = _unit(_matrix(part.column("vec"))) @ asked.T >= cosine
                copies = part.column("copies").to_numpy() @ near
                q = np.flatnonzero(copies)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(copies[q].astype(np.int64))], ["q", "copies"])

    return vectors.select("vec", "copies").mapInArrow(run, "q long, copies long")


def audit(vectors: DataFrame, counts: DataFrame, cosine: float, size: int = AUDIT) -> tuple[float, bool]:
    """Share of the true links that were found, and whether enough vectors with links stand behind it.

    Vectors are drawn by a hash of the id, ``size`` first and then twice as many each time, until ``AUDIT_LINKED`` of them
    have links, all have been drawn, or ``AUDIT_MOST``. The share is the lesser of that over all links and the mean over
    vectors, which one hot group does not hide; 1 without links.
    """
    done, true, found = 0, [], []
    while True:
        drawn = vectors.orderBy(F.xxhash64("rep"), "rep").offset(done).limit(size).select("rep", "vec", "copies").toArrow()
        if drawn.num_rows:
            rep, truth = drawn.column("rep").to_pylist(), -drawn.column("copies").to_numpy()
            for q, n in true_links(vectors, _unit(_matrix(drawn.column("vec"))), cosine).groupBy("q").agg(F.sum("copies")).collect():
                truth[q] += n
            have = {r.u: r.n for r in counts.where(F.col("u").isin(rep)).collect()}
            linked = np.flatnonzero(truth > 0)
            true.extend(truth[linked].tolist())
            found.extend(min(have.get(rep[k], 0), int(truth[k])) for k in linked.tolist())
        done += drawn.num_rows
        over = drawn.num_rows < size
        if over or len(true) >= AUDIT_LINKED or done >= AUDIT_MOST:
            break
        size = min(2 * size, AUDIT_MOST - done)
    share = min(sum(found) / sum(true), float(np.mean(np.array(found) / np.array(true)))) if true else 1.0
    return share, over or len(true) >= AUDIT_LINKED


def near_duplicate_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Links join vectors with a cosine of at least ``cosine`` in double precision; ``n_links`` counts the other
    rows, equal vectors too. Vectors that are NULL, empty, zero, not finite or of another length than most, and
    rows without a key, are linked with nothing. No rows give no rows; rows with one key are one node.
    Labels and other columns are not read. Recall of the search is audited: if it is short, or too few
    vectors with links were drawn to tell, all rows of a block are compared; then the overlap is widened; then an
    error is raised. Pairs below ``cosine`` are never linked.
    """
    ids = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    good = ids.where(usable(F.col("vec")) & F.col("id").isNotNull())
    width = good.agg(F.mode(F.size("vec"), True)).first()[0]
    vectors = staged(good.where(F.size("vec") == F.lit(width)).groupBy("vec").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n = vectors.count()
    homes, exact, links, counts = HOMES, False, None, None
    while n:
        sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow()
        k = max(1, min(MOST_SHARDS, n // SHARD_ROWS))
        centres = fit_centroids(_unit(_matrix(sample.column("vec"))), k)
        placed = _homes(vectors, centres, min(homes, k))
        # powers of two, so that the blocks of two shards nest and a row has few blocks to be marked in
        sizes = placed.groupBy("shard").agg(F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.count("*") / BLOCK_ROWS)))).cast("long").alias("blocks"))
        placed = placed.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        placed = staged(placed, "placed")
        graph = staged(_adjacency(placed), "graph")
        links = staged(_search(placed, graph, cosine, exact), "links")
        counts = staged(_counts(placed, links), "counts")
        share, sure = audit(vectors, counts, cosine)
        if share >= RECALL and (sure or exact):
            break
        if not exact:
            exact = True
        elif homes < min(k, 4 * HOMES):
            homes *= 2
        else:
            raise RuntimeError(f"recall of links stays at {share:.3f}, below {RECALL}, with {homes} homes of a vector")
    if links is None:
        return ids.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                          F.lit(True).alias("kept"))
    named = components(links.where("v is not null").select("u", "v")).withColumnRenamed("id", "rep")
    about = vectors.join(counts.withColumnRenamed("u", "rep"), "rep", "left").join(named, "rep").select(
        "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = ids.join(about.withColumnRenamed("vec", "_vec"), (F.col("vec") == F.col("_vec")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.col(key).eqNullSafe(F.col("component_id")))


def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
