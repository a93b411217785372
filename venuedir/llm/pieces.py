"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's segmentations are the paths of a lattice of pieces; a path's weight is the product of its
pieces' weights. Perturbed A-star search draws the ``k`` segmentations of the largest Gumbel-perturbed
weights, which is sampling without replacement: a node carries the largest perturbed weight of all
its completions, the exact sums of completions are the heuristic, and paths come off the queue in
order. Noise comes from the row key, so reruns agree.

Pieces never cross word borders, so the lattice is a chain of word lattices and each distinct word's is built
once. Regions are split lazily: where no path holds much of a text's probability, the frontier after a found path
stays one region, "all others", whose bound follows from its mass and whose best path is a draw from the
lattice that rejects the paths found before. Texts with a dominant path are searched node by node. Both give the same law.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import fresh, mix, prefix_hash, run_hash, slices, table

MODEL = "piece_bpe_32k.model"
#: Segmentations per text; sharpness of the weights (larger: closer to the best path).
SAMPLES, SHARPNESS = 2, 1.0
#: A text whose best path holds more than this is searched node by node.
DOMINANT = 0.2
#: Draws of a text, beyond the paths wanted, before a search finds the rest.
REJECTIONS = 64
#: Arcs of the lattices that a worker keeps, some 40 bytes each; a word has 25 in the mean.
CACHE_ARCS = 2_000_000
#: Bytes of new words whose lattices are built at once, and of texts drawn side by side.
WORD_BYTES, TEXT_BYTES = 100_000, 250_000
#: Pieces are found by the first bits of their hash.
TABLE_BITS = 20
MARK = "▁"
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORDS = re.compile(f"{MARK}+(?:[{_LATIN}]+|[^{MARK}{_LATIN}]*)|[{_LATIN}]+|[^{MARK}{_LATIN}]+")
_CROSSING = re.compile(f"[{_LATIN}][^{_LATIN}]|[^{MARK}{_LATIN}][{_LATIN}]|[^{MARK}]{MARK}")


class Lattices:
    """The pieces of a model and the lattices of words over them.

    A byte-pair model ranks its pieces but gives no probabilities; rank r weighs ``(r + 10) ** -SHARPNESS``
    (Zipf). Characters without a piece are spelled in byte pieces, each weighing as the rarest rank.
    """

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes = {}, {}
        size = self.model.get_piece_size()
        for i in range(size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.pieces[piece] = (i, -sharpness * math.log(max(-self.model.get_score(i), 0) % 1e9 + 10))
        self.rare = -sharpness * math.log(size + 10)
        self.longest = max(map(len, self.pieces))
        if any(_CROSSING.search(p) for p in self.pieces):
            raise ValueError("pieces cross the borders at which texts are cut")
        spelled = b"".join(p.encode() for p in self.pieces)
        ends = np.cumsum([len(p.encode()) for p in self.pieces])
        hashes = run_hash(prefix_hash(np.frombuffer(spelled, np.uint8)), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        listed = list(self.pieces.values())
        self.of = np.array([i for i, _ in listed], np.int32)[order]
        self.weight = np.array([w for _, w in listed])[order]
        self.byte = np.array([self.bytes[b] for b in range(256)], np.int32)
        slot = (self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)  # rises with the hash
        self.first = np.searchsorted(slot, np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)
        self.crowded = int(np.diff(self.first).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(which, entry)``: the hashes that belong to a piece, and its place in :attr:`hashes`."""
        slot = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        entry, stop = self.first[slot], self.first[slot + 1]
        which = np.flatnonzero(entry < stop)
        entry, stop, wanted = entry[which], stop[which], hashes[which]
        for _ in range(1, self.crowded):  # a slot holds one piece, seldom a few
            entry = entry + ((self.hashes[entry] != wanted) & (entry + 1 < stop))
        real = self.hashes[entry] == wanted
        return which[real], entry[real]

    def word(self, word: str) -> tuple:
        """``(arcs, beta)``: per start the arcs ``(end, id, log weight)``, per place the log sum to the end."""
        n = len(word)
        arcs: list[list] = [[] for _ in range(n)]
        beta = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            out = arcs[i]
            for j in range(i + 1, min(i + self.longest, n) + 1):
                hit = self.pieces.get(word[i:j])
                if hit:
                    out.append((j, hit[0], hit[1]))
            if not out or out[0][0] != i + 1:  # the character itself has no piece
                out.append((i + 1, -1, self.rare * len(word[i].encode())))
            values = [w + beta[j] for j, _, w in out]
            top = max(values)
            beta[i] = top + math.log(sum(math.exp(v - top) for v in values))
        return arcs, beta

    def ids(self, piece_id: int, char: str) -> list[int]:
        return [piece_id] if piece_id >= 0 else [self.bytes[b] for b in char.encode()]


def split_words(text: str) -> list[str]:
    """The text as the model sees it, spaces marked and one in front, cut where words begin."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def _gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def _below(top: float, most: float, g: float) -> float:
    """A Gumbel value ``g`` moved under ``top``, given that the largest of its siblings was ``most``."""
    v = top - g + math.log(max(-math.expm1(g - most), 1e-300))
    return top - max(0.0, v) - math.log1p(math.exp(-abs(v)))


def search(lattices: Lattices, words: list[str], k: int, rng: np.random.Generator) -> list[tuple]:
    """The ``k`` best ``(perturbed log weight, log probability, ids)`` node by node, largest first."""
    built: dict[str, tuple] = {}
    out: list[tuple] = []
    count = 0
    queue = [(-_gumbel(max(rng.random(), 1e-300)), count, 0.0, None, 0, 0)]  # the whole text has log probability 0
    while queue and len(out) < k:
        g, _, prefix, path, w, at = heapq.heappop(queue)
        g = -g
        if w == len(words):
            parts = []
            while path is not None:
                path, part = path
                parts.append(part)
            out.append((g, prefix, [x for part in reversed(parts) for x in part]))
            continue
        word = words[w]
        if word not in built:
            built[word] = lattices.word(word)
        arcs, beta = built[word]
        options = arcs[at]
        phis = [prefix + weight + beta[j] - beta[at] for j, _, weight in options]
        noisy = [phi + _gumbel(max(rng.random(), 1e-300)) for phi in phis]
        most = max(noisy)
        for (j, piece, _), phi, value in zip(options, phis, noisy, strict=True):
            value = g if value == most else _below(g, most, value)
            count += 1
            heapq.heappush(queue, (-value, count, phi, (path, lattices.ids(piece, word[at])), w + (j == len(word)), j % len(word)))
    return out


class Places(dict):
    """Words to their number in :class:`Flat`; a new word gets the next one and is listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Flat:
    """The lattices of the words met so far as arrays, for drawing many paths step by step."""

    def __init__(self, lattices: Lattices, keep: int = CACHE_ARCS):
        self.lattices, self.keep = lattices, keep
        # The arrays have spare room at their ends; `used` tells how much of each is filled.
        self.base, self.best = np.zeros(0, np.int32), np.zeros(0)
        self.end, self.logp, self.cut = np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
        self.start, self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int32)
        self.reset()

    def reset(self) -> None:
        """Forget all words; arrays stay to be filled again, unless a huge text has blown them up."""
        self.place = Places()
        self.used = dict.fromkeys(("base", "best", "end", "logp", "cut", "start", "size", "ids"), 0) | {"first": 1}
        for name, used in self.used.items():
            array = getattr(self, name)
            if len(array) > 4 * self.keep:
                setattr(self, name, array[:used].copy())

    def append(self, name: str, new: np.ndarray) -> None:
        array, used = getattr(self, name), self.used[name]
        until = used + len(new)
        if until > np.iinfo(np.int32).max:
            raise ValueError("the words of one text have too many pieces")
        if until > len(array):
            grown = np.zeros(max(until, used * 3 // 2), array.dtype)
            grown[:used] = array[:used]
            array = grown
            setattr(self, name, array)
        array[used:until] = new
        self.used[name] = until

    def add(self, words: list[str]) -> None:
        """Append the lattices of new words, in the order of their numbers: substrings are looked up by hash, sums run from the words' ends."""
        tables = self.lattices
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        prefix = prefix_hash(data)
        node_byte = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(node_byte)
        edges = np.append(node_byte, len(data))
        word_first = np.searchsorted(node_byte, np.cumsum([0, *map(len, raw)])[:-1])
        word_end = np.append(word_first[1:], n)
        stop = np.repeat(word_end, word_end - word_first)
        nodes = np.arange(n)
        found: list[tuple] = []
        for length in range(1, tables.longest + 1):
            at = nodes[nodes + length <= stop]
            if not len(at):
                break
            h = run_hash(prefix, edges[at], edges[at + length])
            which, entry = tables.find(h)
            found.append((at[which], at[which] + length, tables.of[entry], tables.weight[entry]))
            if length == 1:
                bare = np.delete(at, which)
                found.append((bare, bare + 1, np.full(len(bare), -1, np.int32), tables.rare * (edges[bare + 1] - edges[bare])))
        src, dst, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(src, kind="stable")
        src, dst, piece, weight = src[order], dst[order], piece[order], weight[order]
        first = np.searchsorted(src, np.arange(n + 1))
        beta, best = np.zeros(n + 1), np.zeros(n + 1)  # a word's end is reached with weight 1
        left = stop - nodes
        longest = int(left.max()) if n else 0
        by_left = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable")  # short keys are radix-sorted
        level = np.searchsorted(left[by_left], np.arange(1, longest + 2))
        last = dst == stop[src]
        for a, b in zip(level[:-1], level[1:], strict=True):
            now = by_left[a:b]
            count = first[now + 1] - first[now]
            heads = np.cumsum(count) - count
            arc = np.repeat(first[now] - heads, count) + np.arange(int(count.sum()))
            after = dst[arc]
            beta[now] = np.logaddexp.reduceat(weight[arc] + np.where(last[arc], 0, beta[after]), heads)
            best[now] = np.maximum.reduceat(weight[arc] + np.where(last[arc], 0, best[after]), heads)
        logp = weight + np.where(last, 0, beta[dst]) - beta[src]
        p = np.exp(logp)
        # A draw mostly ends at the first arc it looks at. In steps of 2^-20, so that the order depends on the word alone.
        likely = np.argsort(src - np.floor(p * 2.0**20) * 2.0**-21, kind="stable")
        dst, piece, last, logp, p = dst[likely], piece[likely], last[likely], logp[likely], p[likely]
        total = np.concatenate([[0], np.cumsum(p)])
        run = total[1:] - total[first[src]]
        run[first[1:] - 1] = 2  # the last arc takes what rounding leaves
        base, arcs, spelled_before = self.used["first"] - 1, self.used["end"], self.used["ids"]
        size = np.where(piece < 0, edges[dst] - edges[src], 1)
        spelled = np.repeat(piece, size)
        odd = np.flatnonzero(spelled < 0)
        starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)[odd]
        spelled[odd] = tables.byte[data[edges[src[owner]] + odd - starts[owner]]]
        for name, new in (("base", base + word_first), ("best", best[word_first] - beta[word_first]),
                          ("end", np.where(last, -1, base + dst)), ("logp", logp), ("cut", run),
                          ("start", spelled_before + starts), ("size", size), ("first", arcs + first[1:]), ("ids", spelled)):
            self.append(name, new)

    def places(self, split: list[list[str]]) -> list[np.ndarray]:
        if self.used["end"] > self.keep:
            self.reset()
        found = [np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)) for words in split]
        if self.place.new:
            new, self.place.new = self.place.new, []
            part = np.cumsum([len(w.encode()) for w in new]) // WORD_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(new)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.add(new[a:b])
        return found

    def draw(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(walker, arc)`` of one drawn path from every node to its word's end, in order along each path.

        Every walker has its own stream of uniform numbers, so what others draw does not matter.
        """
        walkers, arcs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live, step = np.arange(len(nodes)), 0
        while len(live):
            step += 1
            u = (mix(seeds[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = self.first[nodes]
            on = np.flatnonzero(u >= self.cut[arc])
            while len(on):
                arc[on] += 1
                on = on[u[on] >= self.cut[arc[on]]]
            walkers.append(live)
            arcs.append(arc)
            nodes = self.end[arc]
            on = nodes >= 0
            live, nodes = live[on], nodes[on]
        walker, arc = np.concatenate(walkers), np.concatenate(arcs)
        order = np.argsort(walker, kind="stable")
        return walker[order], arc[order]

    def paths(self, places: list[np.ndarray], seeds: list[int]) -> list[tuple[float, np.ndarray]]:
        """One drawn ``(log probability, ids)`` per chain of words."""
        counts = np.array([len(x) for x in places], np.int64)
        chain = np.repeat(np.arange(len(places)), counts)
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(counts) - counts, counts)
        noise = mix(mix(np.array(seeds, np.uint64))[chain] + (nth.astype(np.uint64) << np.uint64(20)))
        walker, arc = self.draw(self.base[np.concatenate(places)] if len(places) else np.zeros(0, np.int64), noise)
        size = self.size[arc]
        ids = self.ids[np.repeat(self.start[arc] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        bounds = np.searchsorted(chain[walker], np.arange(len(places) + 1))
        reach = np.concatenate([[0], np.cumsum(size)])[bounds]
        logp = np.bincount(chain[walker], self.logp[arc], len(places))
        return [(float(p), ids[a:b]) for p, a, b in zip(logp, reach[:-1], reach[1:], strict=True)]


def sample_texts(flat: Flat, texts: list[str], seeds: list[int], k: int) -> list[tuple[list[tuple], float]]:
    """Per text up to ``k`` distinct ``(perturbed log probability, log probability, ids)``, largest first, and the next value."""
    split = [split_words(t) for t in texts]
    places = flat.places(split)
    out: list[tuple[list[tuple], float]] = [([], -math.inf)] * len(texts)
    lazy = []
    for i, at in enumerate(places):
        if flat.best[at].sum() > math.log(DOMINANT):
            found = search(flat.lattices, split[i], k + 1, np.random.default_rng(seeds[i]))
            out[i] = (found[:k], found[k][0] if len(found) > k else -math.inf)
        else:
            lazy.append(i)
    drawn: dict[int, list] = {i: [] for i in lazy}
    waiting, turn = lazy, 0
    while waiting and turn < REJECTIONS + k:  # texts that still want a path; what was found before is rejected
        turn += 1
        made = flat.paths([places[i] for i in waiting], [seeds[i] + (turn << 34) for i in waiting])
        for i, path in zip(waiting, made, strict=True):
            if not any(len(x[1]) == len(path[1]) and (x[1] == path[1]).all() for x in drawn[i]):
                drawn[i].append(path)
        waiting = [i for i in waiting if len(drawn[i]) < k]
    for i in waiting:  # the order of a search without the paths drawn before has the law of further draws
        seen = {tuple(ids) for _, ids in drawn[i]}
        found = search(flat.lattices, split[i], k + len(seen), np.random.default_rng([seeds[i], turn]))
        drawn[i] += [(logp, ids) for _, logp, ids in found if tuple(ids) not in seen][: k - len(seen)]
    for i in lazy:
        rng = np.random.default_rng(seeds[i])
        left, bound, paths = 1.0, math.inf, []
        for logp, ids in [*drawn[i], (0.0, None)]:
            noise = -math.log(max(rng.random(), 1e-300)) / left  # the best of a region below the last bound
            bound = -math.log(math.exp(-bound) + noise) if bound > -700 else bound
            paths.append((bound, logp, ids))
            left = max(left - math.exp(logp), 1e-300) if ids is not None else left
        out[i] = (paths[:-1], paths[-1][0] if len(paths) > k else -math.inf)
    return out


@functools.lru_cache(maxsize=1)
def _flat(path: str, sharpness: float) -> Flat:
    """The lattices that a worker keeps from task to task; what was met before changes no result."""
    return Flat(Lattices(path, sharpness))


def _seed(key: object, text: str) -> int:
    return zlib.crc32(str(key).encode()) if key is not None else zlib.crc32(text.encode()) + (1 << 32)


def decode(model: sentencepiece.SentencePieceProcessor, ids: list[int]) -> str:
    return model.decode(ids)


def sample_segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES,
                         sharpness: float = SHARPNESS, vocabulary: str | None = None) -> DataFrame:
    """``docs`` without the text, plus ``segmentations`` and ``decoded`` per row.

    ``segmentations`` lists up to ``k`` distinct segmentations, largest perturbed weight first: ``ids``, ``logp``
    (log probability), ``perturbed`` (log probability plus Gumbel noise) and ``inclusion`` (probability of being
    sampled given the next perturbed value, ``1 - exp(-exp(logp - next))``; 1 where all were taken). ``decoded`` tells
    whether each decodes to the text. NULL and empty texts have the empty segmentation; a text with fewer
    segmentations than ``k`` lists all. Rows with equal key and text get equal samples, NULL keys are seeded by
    the text. Columns that already carry the added names are replaced.
    """
    path = vocabulary or public_tokenizers.path(MODEL)
    kept = docs.drop("segmentations", "decoded")
    others = [c for c in kept.columns if c != text]
    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])
    at_text, at_key = kept.columns.index(text), kept.columns.index(key)
    keep = [i for i in range(len(kept.columns)) if i != at_text]
    seg, ok = fresh([f"c{i}" for i in keep], "segmentations", "decoded")
    item = pa.struct([("ids", pa.list_(pa.int32())), ("logp", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _flat(path, sharpness)
        for part in slices(batches, f"c{at_text}", TEXT_BYTES):
            texts = [t or "" for t in part.column(at_text).to_pylist()]
            seeds = [_seed(row_key, t) for row_key, t in zip(part.column(at_key).to_pylist(), texts, strict=True)]
            ids, counts, rows, numbers, decoded = [], [], [], [], []
            for one, (found, limit) in zip(texts, sample_texts(flat, texts, seeds, k), strict=True):
                for g, logp, path_ids in found:
                    ids.append(np.asarray(path_ids, np.int32))
                    numbers.append((logp, g, -math.expm1(-math.exp(min(logp - limit, 50.0)))))
                rows.append(len(found))
                counts += [len(x[2]) for x in found]
                decoded.append(all(decode(flat.lattices.model, np.asarray(x[2]).tolist()) == one for x in found))
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                             pa.array(np.concatenate(ids) if ids else np.zeros(0), pa.int32()))
            scores = np.array(numbers).reshape(-1, 3)
            items = pa.StructArray.from_arrays([inner, *[pa.array(scores[:, c]) for c in range(3)]], fields=list(item))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], listed, pa.array(decoded, pa.bool_())],
                                             [*[f"c{i}" for i in keep], seg, ok])

    schema = ", ".join(f"c{i} {plain.schema[i].dataType.simpleString()}" for i in keep)
    made = plain.mapInArrow(run, f"{schema}{', ' if schema else ''}{seg} array<struct<ids: array<int>, logp: double, "
                                f"perturbed: double, inclusion: double>>, {ok} boolean")
    return made.toDF(*others, "segmentations", "decoded")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled segmentations of every document: lengths, scores and checksums in order of the sample."""
    made = sample_segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sums = F.transform("segmentations", lambda s: F.xxhash64(s["ids"]))
    return made.select("doc_id", F.transform("segmentations.ids", F.size).alias("n_tokens"), sums.alias("ids_hash"),
                       F.col("segmentations.logp").alias("logp"), F.col("segmentations.perturbed").alias("perturbed"),
                       F.col("segmentations.inclusion").alias("inclusion"), "decoded")
