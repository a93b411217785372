"""Token ids as Parquet list columns that allow selective reads.

Documents are range-partitioned and sorted by id, encoded in Arrow batches and written by
Spark's Parquet writer: metadata columns with dictionary encoding, token ids with delta
encoding, small row groups and pages with a page index. A reader that wants some documents
or only the metadata touches the pages that hold them.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from venuedir.llm.common import scratch, slices, table

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Row groups and pages of the files, in bytes.
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10
#: Distinct words whose ids a Python worker keeps, some 250 bytes each.
CACHE_WORDS = 800_000

#: Text encoded at once; distinct words are looked up once in each piece.
SLICE_BYTES = 4_000_000

#: Marks that are cut off the words they follow.
ENDS = ".,"

# How byte-level BPE cuts a text into words (fixed by the vocabulary's pre-tokenizer).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts; every distinct word is encoded once.

    A single space between two characters that are no white space always starts a new
    word, so a text may be cut there and its pieces encoded alone. The library's model encodes each
    word; pieces that hold a special token go through the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.keep = keep
        self.reset()

    def reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.lengths = array("i")
        self.starts = array("q")
        self.flat = array("i")

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before single spaces; every piece but the first begins with its space."""
        if not text:
            return []
        cut = text.split(" ")
        lines = text.replace("\n", "n")  # a line end inside a piece is no reason to look closer, one beside a space is
        if " \n" in text or "\n " in text or lines.split() != (cut if lines is text else lines.split(" ")):
            cut = regex.split(r"(?<=\S) (?=\S)", text)
        return [cut[0], *[" " + x for x in cut[1:]]]

    def _add(self, piece: str, ids: Sequence[int]) -> None:
        self.codes[piece] = len(self.lengths)
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)

    def _word(self, word: str) -> list[int]:
        if word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            spelled = self.space + word[1:] if word[0] == " " else word
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(spelled)]

    def _learn(self, pieces: list[str]) -> None:
        odd, letters = [], []
        for piece in pieces:
            if piece in self.codes:  # as a part of another piece
                continue
            if (piece[1:] if piece[0] == " " else piece).isalpha():
                letters.append(piece)
            elif any(s in piece for s in self.special):
                odd.append(piece)
            else:
                parts = WORDS.findall(piece)
                for part in parts:
                    if part not in self.codes:
                        self._add(part, self._word(part))
                if len(parts) > 1:
                    at = [self.codes[part] for part in parts]
                    self._add(piece, [i for c in at for i in self.flat[self.starts[c]:self.starts[c] + self.lengths[c]]])
        for piece in letters:
            if piece not in self.codes:
                self._add(piece, self._word(piece))
        for piece, done in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self._add(piece, done.ids)

    def _codes(self, pieces: list[str]) -> np.ndarray:
        """The numbers of all pieces; those seen for the first time are learned."""
        codes = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(codes < 0)
        if len(new):
            missing = [pieces[k] for k in new.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            codes[new] = np.fromiter(map(self.codes.__getitem__, missing), np.int64, len(missing))
        return codes

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(codes of the pieces, pieces per text)``.

        Arrow cuts at every space and tells equal pieces apart, so Python sees each distinct one once. A text
        with a space beside other white space is cut by :meth:`pieces` instead.
        """
        cut = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        firsts, lasts = ends - counts, ends - 1
        coded = cut.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        head = pc.not_equal(pc.utf8_ltrim_whitespace(words), words).to_numpy(zero_copy_only=False) | empty
        tail = pc.not_equal(pc.utf8_rtrim_whitespace(words), words).to_numpy(zero_copy_only=False) | empty
        bad_head, bad_tail = head[at], tail[at]
        bad_head[firsts] = bad_tail[lasts] = False
        odd = np.add.reduceat((bad_head | bad_tail).astype(np.int64), firsts) > 0
        odd |= (counts == 1) & empty[at[firsts]]

        spaced = np.repeat(~odd, counts)
        spaced[firsts] = False
        used = np.zeros(len(words), bool)
        used[at[spaced]] = True
        used = np.flatnonzero(used)
        # A full stop or comma behind letters is a word of its own, so only the letters have to be known.
        names = words.take(pa.array(used))
        stems = pc.utf8_rtrim(names, characters=ENDS)
        pair = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & (
            pc.subtract(pc.binary_length(names), pc.binary_length(stems)).to_numpy(zero_copy_only=False) == 1)
        stems = pc.if_else(pa.array(pair), stems, names).dictionary_encode()
        body, ends_with = np.full(len(words), -1, np.int64), np.full(len(words), -1, np.int64)
        body[used] = self._codes([" " + w for w in stems.dictionary.to_pylist()])[stems.indices.to_numpy(zero_copy_only=False)]
        for mark, code in zip(ENDS, self._codes(list(ENDS)).tolist(), strict=True):
            ends_with[used[pair & pc.ends_with(names, mark).to_numpy(zero_copy_only=False)]] = code
        first, second = body[at], ends_with[at]
        plain = np.flatnonzero(~odd)
        first[firsts[plain]] = self._codes(words.take(pa.array(at[firsts[plain]])).to_pylist())
        second[firsts] = -1
        wide = 1 + (second >= 0)
        codes = np.repeat(first, wide)
        codes[np.cumsum(wide)[second >= 0] - 1] = second[second >= 0]
        counts = np.add.reduceat(wide, firsts)
        slow = np.flatnonzero(odd)
        if len(slow):
            taken = {k: self._codes(self.pieces(text)) for k, text in zip(slow.tolist(), texts.take(pa.array(slow)).to_pylist(), strict=True)}
            until = np.cumsum(counts)
            parts = [taken[k] if k in taken else codes[until[k] - counts[k]:until[k]] for k in range(len(counts))]
            codes, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return codes, counts

    def encode(self, texts: pa.Array | list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, n_tokens)`` of all texts, each closed by ``end_id``; NULL is an empty text."""
        if len(self.codes) > self.keep:
            self.reset()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        codes, counts = self._cut(texts) if len(texts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # copies, because arrays that are viewed cannot grow
        known, starts, flat = np.array(self.lengths), np.array(self.starts), np.array(self.flat)
        lengths = known[codes].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        at = np.repeat(starts[codes] - (np.cumsum(lengths) - lengths), lengths)
        ids = flat[at + np.arange(len(at))]
        sizes = np.diff(bounds)
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            sizes = sizes + 1
        return ids, sizes


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per Python worker, so that tasks after the first find its words."""
    return Encoder(path)


def encode_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                  end_id: int | None = END_ID) -> DataFrame:
    """``(key, n_tokens, ids)`` for every row; NULL texts count as empty and hold the end id alone."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part in slices(batches, "text", SLICE_BYTES):
            ids, sizes = encoder.encode(part.column("text"), end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))],
                ["key", "n_tokens", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids array<int>").withColumnRenamed("key", key)


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                      vocabulary: str | None = None, end_id: int | None = END_ID) -> None:
    """Token files below ``path``, in ascending order of the key (NULL first) within and across files.

    Equal keys stay in one file. The ids are delta-encoded (format version 2, no
    dictionary); ``n_tokens`` and the key keep theirs. A task that runs again replaces its own file.
    """
    ordered = docs.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    made = encode_tokens(ordered, key, text, vocabulary, end_id)
    (made.write.option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary#ids.list.element", "false")
     .option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES))
     .option("compression", "zstd").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; select or filter before an action, and only those columns and pages are read."""
    return spark.read.parquet(path)


def _place(*also: str) -> list[Column]:
    """Columns ``also``, file and row number inside it of every row that is read."""
    return [*map(F.col, also), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def _with_start(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` and ``start``: tokens of all rows before, in the order of the files.

    Running sums inside files plus the totals of the files before: one row per file meets in
    one place, never one per document. Equal keys follow as they are stored.
    """
    totals = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_n"), F.min(key).alias("_low"))
    order = Window.orderBy(F.col("_low").asc_nulls_first(), "_file")
    before = totals.select("_file", (F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
                           .alias("_before"))
    inside = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_until", F.sum("n_tokens").over(inside)).join(before, "_file")
    return rows.withColumn("start", F.col("_before") + F.col("_until") - F.col("n_tokens"))


def token_offsets(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens)``: tokens of all documents before, in key order; reads no ids."""
    return _with_start(files.select(*_place(key, "n_tokens")), key).select(key, "start", "n_tokens")


def _sums(rows: DataFrame) -> DataFrame:
    """``rows`` with ``(n_tokens, ids_crc32)`` in place of their last column, ``ids``."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            raw = ids.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())],
                [*kept, "n_tokens", "ids_crc32"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, f"{kinds}n_tokens long, ids_crc32 long")


def token_sums(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, ids_crc32)`` of the stored ids as little-endian 32-bit integers."""
    return _sums(files.select(key, "ids"))


def token_places(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every stored row out of one read, so that repeated and NULL keys keep their own."""
    rows = _with_start(_sums(files.select(*_place(key), "ids")), key)
    return rows.select(key, "start", "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document, all read back from the token files."""
    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_places(read_tokens(spark, path))
