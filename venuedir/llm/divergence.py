"""How far the sources of a language differ in their words.

Terms are counted in numpy, bucketed by length: up to 8 bytes are one unsigned 64-bit word,
up to 16 two of them, radix-sorted by 16-bit digits and counted by runs; longer terms lie in one
bucket per length and are sorted as bytes. Spark adds the counts up, keeps the terms of enough
documents and compares smoothed integer probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuedir.llm.common import staged, table, utf8
from venuedir.operators.skew import lookup

#: A term stays if at least so many documents of its language hold it.
MIN_DOCUMENTS = 30
#: Probabilities are integers in units of one billionth; every count is smoothed by five.
UNIT, SMOOTHING = 1_000_000_000, 5
#: Terms reported per source.
TOP_TERMS = 50
#: Text sorted at once; more in one go combines more counts, at some 15 bytes of memory a byte.
SORT_BYTES, SORT_ROWS = 12_000_000, 1 << 16
#: Sources in one block of the pairwise comparison, and rows of counts in one of its groups.
BLOCK_SOURCES, GROUP_ROWS = 128, 20_000

# Bytes of a term: ASCII letters and everything beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, row)`` of all terms; terms never cross rows."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _TERM[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A run over the border of two rows is cut there.
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    border = np.unique(border[_TERM[data[border]] & _TERM[data[border - 1]]])
    if len(border):
        start, end = np.sort(np.concatenate([start, border])), np.sort(np.concatenate([end, border]))
    return start, end - start, np.searchsorted(offsets, start, "right") - 1


def packed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Eight bytes from each start as one unsigned word, the first byte highest, zeros behind the term."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[start]).view(">u8").ravel().astype(np.uint64)
    drop = np.clip(8 - length, 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(drop >= 64, np.uint64(0), (words >> np.minimum(drop, np.uint64(63))) << np.minimum(drop, np.uint64(63)))


def radix_order(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order`` sorted stably by the words, the first one highest: counting passes over 16-bit digits, last digit first."""
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16-bit keys
    return order


def _counted(same_term: np.ndarray, rank: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, occurrences and rows of every run of one term in one group; all inputs in sorted order."""
    n = len(rank)
    new_row = np.ones(n, bool)
    new_row[1:] = ~same_term | (rank[1:] != rank[:-1])
    new_group = np.ones(n, bool)
    new_group[1:] = ~same_term | (group[1:] != group[:-1])
    first = np.flatnonzero(new_group)
    if not n:
        return first, first, first
    return first, np.diff(np.append(first, n)), np.add.reduceat(new_row.astype(np.int64), first)


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> list[tuple]:
    """``(group, word 0, word 1, long terms or None, occurrences, rows)`` arrays, one tuple per bucket.

    ``group`` numbers the group of every row. Rows of one group take neighbouring ranks, so that
    one more digit sorts the occurrences of a term by group and row.
    """
    data = _LOWER[data]
    start, length, row = term_runs(data, offsets)
    rank_of = np.empty(len(group), np.uint64)
    rank_of[np.argsort(group, kind="stable")] = np.arange(len(group), dtype=np.uint64)
    rank = rank_of[row]
    out = []
    for low, high in ((1, 8), (9, 16)):
        at = np.flatnonzero((length >= low) & (length <= high))
        w0 = packed(data, start[at], length[at])
        w1 = packed(data, start[at] + 8, length[at] - 8) if high > 8 else np.zeros(len(at), np.uint64)
        order = radix_order([w0, w1], radix_order([rank[at]], np.arange(len(at))))
        w0, w1, groups = w0[order], w1[order], group[row[at[order]]]
        first, n, rows = _counted((w0[1:] == w0[:-1]) & (w1[1:] == w1[:-1]), rank[at[order]], groups)
        out.append((groups[first], w0[first], w1[first], None, n, rows))
    for size in np.unique(length[length > 16]).tolist():
        at = np.flatnonzero(length == size)
        at = at[np.argsort(rank[at], kind="stable")]
        text = np.empty((len(at), size), np.uint8)
        for k, s in enumerate(start[at].tolist()):
            text[k] = data[s:s + size]
        text = text.view(f"S{size}").ravel()
        order = np.argsort(text, kind="stable")
        text, at = text[order], at[order]
        first, n, rows = _counted(text[1:] == text[:-1], rank[at], group[row[at]])
        zero = np.zeros(len(first), np.uint64)
        out.append((group[row[at]][first], zero, zero, text[first].tolist(), n, rows))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows gathered to about ``SORT_BYTES`` of text, one row at least and ``SORT_ROWS`` at most."""
    held, size, rows = [], 0, 0
    for batch in batches:
        sizes = np.diff(utf8(batch.column("text"))[1])
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, done + SORT_BYTES - size, "right")), at + (not rows))
            to = min(to, at + SORT_ROWS - rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                size, rows = size + int(ends[to - 1] - done), rows + to - at
            at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        data, offsets = utf8(piece.column("text"))
        names = [piece.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
        lang, source = (n.indices.to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
        pair, group = np.unique(lang * (len(names[1].dictionary) + 1) + source, return_inverse=True)
        langs, sources = (names[0].dictionary.take(pa.array(pair // (len(names[1].dictionary) + 1))),
                          names[1].dictionary.take(pa.array(pair % (len(names[1].dictionary) + 1))))
        for groups, w0, w1, long, n, rows in count_terms(data, offsets, group):
            if len(groups):
                of = pa.array(groups)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(of), sources.take(of), pa.array(w0.view(np.int64)), pa.array(w1.view(np.int64)),
                     pa.array(long if long is not None else [None] * len(of), pa.binary()), pa.array(n, pa.int64()), pa.array(rows, pa.int64())],
                    ["lang", "source", "w0", "w1", "long", "n", "docs"])


_COUNTS = "lang string, source string, w0 long, w1 long, long binary, n long, docs long"


def _unpacked() -> Column:
    """The term's text from its words, or from the long column."""
    digits = F.regexp_replace(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in ("w0", "w1")]), "(00)+$", "")
    return F.decode(F.coalesce("long", F.unhex(digits)), "utf-8")


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               least: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, lang_n, head)`` of every kept term in every group that holds it.

    ``n`` counts its occurrences there and ``lang_n`` those in the whole language; ``head`` marks one row per
    language and term. Every row is a document of its own, even if it repeats another.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    term = ["lang", "w0", "w1", "long"]
    # Groups are combined over a whole piece of text before the shuffle; a frequent term then sends a few rows per task.
    counts = rows.mapInArrow(_count_batches, _COUNTS).repartition(*term)
    counts = counts.groupBy(*term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy(*term)
    counts = counts.withColumns({"lang_n": F.sum("n").over(of), "lang_docs": F.sum("docs").over(of)}).where(F.col("lang_docs") >= least)
    counts = counts.withColumn("head", F.row_number().over(of.orderBy("source")) == 1)
    return counts.select("lang", "source", _unpacked().alias("term"), "n", "lang_n", "head")


def _share(n: str, total: str, terms: str) -> Column:
    """``1 + floor(UNIT * (n + 5) / (total + 5 * terms))``, exact for any count."""
    return F.expr(f"1 + cast(cast({UNIT} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(20,0)) "
                  f"div cast({total} + {SMOOTHING} * {terms} as decimal(20,0)) as bigint)")


def groups_of(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) of ``docs``: its total ``total``, and of its language ``terms``, ``lang_total`` and ``sources``."""
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads"))
    seen = seen.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "heads"])
    whole = seen.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"), F.count("*").alias("sources"))
    return lookup(seen.drop("heads"), whole, ["lang"])


def term_gaps(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The terms that each group uses more than its language does, by the gap, ``top`` per group."""
    rows = lookup(kept, groups, ["lang", "source"])
    gap = _share("n", "total", "terms") - _share("lang_n", "lang_total", "terms")
    rows = rows.select("lang", "source", F.col("term").alias("item"), gap.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of differences between the sources of two blocks over one bucket of terms.

    Rows without a term bring in all sources of the blocks. The distance as if neither source held any term is added
    once, in bucket 0, and corrected for every term that is held. Each other row is one count: ``p`` there, ``p0`` for a count of zero.
    """
    lang, left, right = key[0].as_py(), key[1].as_py(), key[2].as_py()
    names = rows.column("source").combine_chunks().dictionary_encode()
    source = names.indices.to_numpy(zero_copy_only=False)
    count = len(names.dictionary)
    p, p0, terms, block = (rows.column(c).to_numpy() for c in ("p", "p0", "terms", "block"))
    base, block_of = np.zeros(count, np.int64), np.zeros(count, np.int64)
    base[source], block_of[source] = p0, block
    real = rows.column("term").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    rest = np.abs(base[:, None] - base)
    total = rest * int(terms[0] if key[3].as_py() == 0 else 0)
    at = np.flatnonzero(real)
    code = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[at].astype(np.int64)
    at, code = at[np.argsort(code, kind="stable")], np.sort(code)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        a, b = np.searchsorted(code, [low, low + 2048])
        table = np.tile(base, (int(code[b - 1]) - low + 1, 1))
        table[code[a:b] - low, source[at[a:b]]] = p[at[a:b]]
        for s in range(count):
            total[s] += np.abs(table - table[:, s:s + 1]).sum(0) - rest[s] * len(table)
    one, other = np.nonzero((block_of[:, None] == left) & (block_of == right) | (block_of[:, None] == right) & (block_of == left))
    one, other = one[one != other], other[one != other]
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": names.dictionary.take(pa.array(one)),
                     "item": names.dictionary.take(pa.array(other)), "value": pa.array(total[one, other], pa.int64())})


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value, rank)``: the distance of every two sources of a language, over all kept terms.

    Sources lie in blocks of bounded size and terms in hash buckets. A task takes two blocks and one bucket, so neither a
    source with a third of all rows nor a term that all sources share meets in one place, and only sums per pair leave it.
    """
    blocks = F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int")
    none = F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(F.lit(0))
    groups = groups.withColumns({"p0": none.cast("long"), "blocks": blocks})
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    buckets = max(1, kept.count() // GROUP_ROWS)
    counts = lookup(kept.drop("lang_n", "head"), groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "terms").alias("p"), "p0", "terms", "block", "blocks",
        F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    empty = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "p0", "terms",
                          "block", "blocks", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    rows = counts.union(empty).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"), "bucket",
                       "source", "term", "p", "p0", "terms", "block")
    parts = rows.groupBy("lang", "left", "right", "bucket").applyInArrow(_compare, "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return sums.withColumn("rank", rank)


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: pairs of sources and their terms, each ranked per source.

    NULLs read as empty texts; a source or language of that name is the same one. Groups without any term still
    have pairs. An empty table gives no rows. Further columns are ignored. Repeated rows count as documents of their own.
    """
    kept = staged(kept_terms(docs, text, lang, source, least), "terms")
    groups = staged(groups_of(docs, kept, lang, source), "groups")
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
             for part, rows in (("pair", source_distances(kept, groups)), ("term", term_gaps(kept, groups, top)))]
    return parts[0].union(parts[1])


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = """with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
t as (select lang, source, r, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from t group by lang, term having count(distinct r) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t group by all),
f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.lang_n from g join kept k on g.lang = k.lang
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n,
    1 + (cast(1000000000 as hugeint) * (n + 5)) // cast(sum(n) over w + 5 * count(*) over w as hugeint) as p,
    1 + (cast(1000000000 as hugeint) * (lang_n + 5)) // cast(sum(lang_n) over w + 5 * count(*) over w as hugeint) as q
    from f window w as (partition by lang, source)),
pairs as (select a.lang, a.source, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (select l.lang, l.source, o.source as item, sum(abs(l.p - o.p)) as value
        from p l join p o on l.lang = o.lang and l.term = o.term group by all) x
      on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, term as item, cast(p - q as bigint) as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
  cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value,
  cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from terms) where rank <= 50"""
