"""Exact Jaccard self-join of word-shingle sets with signature trees, and its components.

1. A document's set: 64-bit hashes of its distinct k-word shingles. Documents
   with equal sets (same 64-bit set digest) count once from here on.
2. In any one global order, linked sets have at least ``c`` tokens in common among
   their first ``n - ceil(t n) + c`` ones; c is 1 + n / 50, the lesser of the two sets'. The order
   puts tokens that a corpus-wide sketch of counts calls frequent last, ties by hash. Sets
   that share such a token form a shard; a set with fewer tokens in shards than the c of the smallest set it may link to links with none.
3. Near copies first: within a shard and size band every set is compared with
   the shard's least set; exact links found so join sets to groups.
4. Signature trees for the rest: each shard that still spans several groups is
   a tree whose nodes hold the OR of their sets' token bitmaps and ranges of set
   sizes. A tree is traversed against itself, dropping node pairs whose greatest
   possible overlap falls short; leaf pairs of different groups connect sets to meetings, told set by set, so that
   rows do not grow with pairs. A shard of more than ``BLOCK`` sets is dealt in pairs of blocks. Meetings that share sets
   become one, up to two blocks. The sets of a meeting are compared exactly, in the order of its own tree, and only where links found so far leave them apart.
5. Components of all links.

Nothing is capped: a pruned pair cannot reach the threshold, and links inside a
group change no component. Set digests and shingles are 64-bit hashes: two different ones agree with chance 2**-64; a row's place is kept in 128 bits.

Defined cases: null texts and texts without words have an empty set and no
links; texts of fewer than k words are one shingle; repeated and null
identifiers are separate rows (a component's id is its least known
identifier); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import LOWER, RangeHash, Words, mix, window_hash
from .common import Text, doc_slices, few, give_back, materialize, pick, ship_package
from .components import components
from .stream_dedup import file_backed, located, placed

#: Counters of the frequency sketch (2**_SKETCH, a byte each: 32 MB) and of one of its rows in a shuffle. Counts end at
#: 255. The sketch orders tokens only; the more tokens a counter stands for, the more sets meet by chance.
_SKETCH, _CHUNK = 25, 1 << 14
#: Files that the sketch's sums are written to, 1 MB each; the driver reads a few of them at a time.
_SKETCH_FILES = 32
#: Bits of a set's token bitmap.
_BITS = 2048
#: Sets of one shard that one task compares; larger shards are dealt in block pairs.
BLOCK = 2048
#: Two linked sets, the smaller of n elements, have 1 + n // _EACH common tokens among their first ones; higher counts drop more chance meetings.
_EACH = 50
#: Times that sets with too few shared tokens are dropped, and shards left with one set after them.
_PEELS = 1
#: Rounds that compare near copies with the first of their shard before all others are.
_ROUNDS = 2
#: Children of a tree node.
_FAN = 8
#: 64-bit words of the exact bitmaps of one meeting's sets (32 MB); where more are needed, its sets are compared pair by pair.
_EXACT_WORDS = 4 << 20
#: Text bytes that one pass of a worker takes; a longer text is a pass of its own.
_SLICE = 1 << 19
#: A row's place: 128 bits of its file and its number there.
_LOC, _LOC_TYPE = "struct<x: long, y: long>", pa.struct([("x", pa.int64()), ("y", pa.int64())])


def shingle_sets(t: Text, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    data = LOWER[t.data]
    w = Words(Text(data, t.offsets, t.first))
    word = RangeHash(data)(w.start, w.end)
    win = window_hash(word, k)
    out = []
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(win[a : b - k + 1]))
        elif b > a:
            out.append(window_hash(word[a:b], b - a) ^ np.uint64(b - a))  # a short text is no k-word shingle
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(s: np.ndarray) -> int:
    """64-bit digest of a set, as a signed number."""
    total = mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total ^ mix(np.array([len(s) + 1], np.uint64))).view(np.int64)[0])


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - _SKETCH)).astype(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, np.uint8)
    bits[(s & np.uint64(_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def least_overlap(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection with which sets of n and m elements reach num / den."""
    return -(-num * (n + m) // (num + den))


def _read(rows: DataFrame, k: int) -> DataFrame:
    """First pass: ``doc_id, loc, n, sid`` of every row, and the sketch's parts as rows with ``chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "loc", "n", "sid", "chunk", "counts"]
        sketch = np.zeros(1 << _SKETCH, np.uint8)
        for part, t in doc_slices(batches, "t", _SLICE):
            sets = shingle_sets(t, k)
            cells = [_cell(s) for s in sets]
            cell, seen = np.unique(np.concatenate(cells), return_counts=True)
            sketch[cell] = np.minimum(sketch[cell] + seen, 255)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["loc"].cast(_LOC_TYPE), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.int64()),
                 pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names,
            )
        if sketch.any():
            parts = sketch.reshape(-1, _CHUNK)
            for at in range(0, len(parts), 64):
                some = [p.tobytes() for p in parts[at : at + 64]]
                number, place = pa.nulls(len(some), pa.int64()), pa.nulls(len(some), _LOC_TYPE)
                yield pa.RecordBatch.from_arrays(
                    [number, place, number, number, pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.binary())], names=names
                )
        del sketch
        give_back()

    return rows.mapInArrow(run, f"doc_id long, loc {_LOC}, n long, sid long, chunk int, counts binary")


def _levels(seen: DataFrame) -> np.ndarray:
    """Counts of all sketch cells (a fixed number of bytes, whatever the corpus)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b["chunk"].to_pylist(), b["counts"], strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(raw.as_buffer(), np.uint8).astype(np.uint32)
        for c, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.minimum(x, 255).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "counts"])

    level = np.zeros(1 << _SKETCH, np.uint8)
    parts = seen.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    parts = materialize(parts.repartition(_SKETCH_FILES), "jaccard-sketch")
    for r in parts.toLocalIterator():  # a job for each partition, of some of the files
        level[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, np.uint8)
    return level


def _prefixes(rows: DataFrame, k: int, shared: Broadcast, num: int, den: int) -> DataFrame:
    """Second pass: ``token, sid, n`` for the prefix tokens of every set; ``shared``: the sketch's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for _, t in doc_slices(batches, "t", _SLICE):
            tokens, sids, sizes = [], [], []
            for s in shingle_sets(t, k):
                n = len(s)
                if n:
                    head = s[np.argsort(level[_cell(s)], kind="stable")[: n - (-(-num * n // den)) + 1 + n // _EACH]]
                    tokens.append(head)
                    sids.append(np.full(len(head), set_digest(s)))
                    sizes.append(np.full(len(head), n))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([x.view(np.int64) for x in tokens], sids, sizes)], names=["token", "sid", "n"])
        give_back()

    return rows.select("t").mapInArrow(run, "token long, sid long, n long")


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """Third pass, over one document of each set in a shard: ``sid, n, bits, body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in doc_slices(batches, "t", _SLICE):
            sets = shingle_sets(t, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["sid", "n", "bits", "body"],
            )
        give_back()

    return rows.select("t").mapInArrow(run, "sid long, n long, bits binary, body binary")


def _matrix(col: pa.Array) -> np.ndarray:
    """Bitmaps of a column as rows of 64-bit words."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)


def _outside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits of each row of x that y lacks: as many tokens at least are in x only."""
    return np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)


def _may_link(bits_x, n_x, bits_y, n_y, num: int, den: int) -> np.ndarray:
    most = np.minimum(n_x - _outside(bits_x, bits_y), n_y - _outside(bits_y, bits_x))
    return most >= least_overlap(n_x, n_y, num, den)


class Tree:
    """Signature tree over sets sorted by size; level 0 are the sets themselves, every higher node covers ``_FAN`` below."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, ones)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, few = self.levels[-1]
            at = np.arange(0, len(b), _FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(few, at)))

    def pairs(self, num: int, den: int, distinct: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of sets that may reach the threshold; ``distinct``: group of each set, equal groups are no pair.

        Depth first with a bounded frontier, so memory does not grow with the number of pairs.
        """
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            bits, lo, hi, few = self.levels[level]
            if level == 0:
                keep = (a < b) & (distinct[a] != distinct[b])
                a, b = a[keep], b[keep]
                keep = _may_link(bits[a], lo[a], bits[b], lo[b], num, den)
                yield a[keep], b[keep]
                continue
            common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            most = np.minimum(hi[a] - np.maximum(few[a] - common, 0), hi[b] - np.maximum(few[b] - common, 0))
            # sizes within reach of each other, and enough tokens that can be common
            keep = (den * hi[a] >= num * lo[b]) & (den * hi[b] >= num * lo[a]) & (most >= least_overlap(lo[a], lo[b], num, den))
            a, b = a[keep], b[keep]
            size = len(self.levels[level - 1][0])
            for i in range(0, len(a), 512):  # the bitmaps of as many pairs' children are 8 MB
                kids = np.arange(_FAN)
                x = np.repeat(a[i : i + 512, None, None] * _FAN + kids[None, :, None], _FAN, axis=2).ravel()
                y = np.repeat(b[i : i + 512, None, None] * _FAN + kids[None, None, :], _FAN, axis=1).ravel()
                inside = (x < size) & (y < size) & (x <= y)
                todo.append((level - 1, x[inside], y[inside]))


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by ``keys``; the last group of a batch may go on in the next."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        cols = [t[c].to_numpy() for c in keys]
        last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if held and cut == 0 and all(held[-1][c][-1].as_py() == t[c][0].as_py() for c in keys):
            held.append(t)
            continue
        if cut or held:
            yield pa.concat_tables([*held, t.slice(0, cut)])
        held = [t.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def _spans(t: pa.Table, keys: tuple[str, ...]) -> list[tuple[int, int]]:
    """First row and end of each group of equal ``keys``."""
    cols = [t[c].to_numpy() for c in keys]
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    return list(zip([0, *new.tolist()], [*new.tolist(), len(t)], strict=True)) if len(t) else []


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those of the pairs that join two labels, one after the other; ``label`` is kept up to date."""
    while len(keep := np.flatnonzero(label[a] != label[b])):
        a, b = a[keep], b[keep]
        x, y = int(a[0]), int(b[0])
        label[label == label[y]] = label[x]
        yield x, y


def _meetings(shards: DataFrame, num: int, den: int) -> DataFrame:
    """``meet, first, sid, root``: the sets that candidate pairs of one shard connect, of rows ``token, i, j, block, sid, n, bits, root``.

    A row for each set and not for each pair; ``meet`` is a digest of the sets, so the same ones that meet in several shards are told once; ``first`` is one of them.
    """
    keys = ("token", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_keys(batches, keys):
            i, j, block, sid, n, root = (x[c].to_numpy() for c in ("i", "j", "block", "sid", "n", "root"))
            bits = _matrix(x["bits"].combine_chunks())
            meets, firsts, found = [], [], []
            for lo, hi in _spans(x, keys):
                if hi - lo < 2:
                    continue
                order = lo + np.lexsort((sid[lo:hi], n[lo:hi]))
                label, met = np.arange(hi - lo), np.zeros(hi - lo, bool)
                for a, b in Tree(bits[order], n[order]).pairs(num, den, root[order]):
                    if i[lo] != j[lo]:
                        cross = block[order[a]] != block[order[b]]
                        a, b = a[cross], b[cross]
                    met[a] = met[b] = True
                    for _ in _forest(a, b, label):
                        pass
                at = np.flatnonzero(met)
                at = at[np.argsort(label[at], kind="stable")]
                for some in np.split(at, np.flatnonzero(np.diff(label[at])) + 1) if len(at) else ():
                    names = np.sort(sid[order[some]])
                    meets.append(np.full(len(some), set_digest(names.view(np.uint64))))
                    firsts.append(np.full(len(some), names[0]))
                    found.append(order[some])
            if found:
                at = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(meets), np.concatenate(firsts), sid[at], root[at])], names=["meet", "first", "sid", "root"])
        give_back()

    return shards.mapInArrow(run, "meet long, first long, sid long, root long").distinct()


def _gathered(met: DataFrame) -> DataFrame:
    """``meet, sid, root``: meetings that share sets become one, so that each set goes to one place; those of more than two blocks stay apart."""
    whole = materialize(components(met.select(F.col("sid").alias("a"), F.col("first").alias("b"))), "jaccard-whole")
    size = whole.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    whole = whole.join(size, "root").select(F.col("id").alias("sid"), F.col("root").alias("whole"), "size")
    one = met.groupBy("sid").agg(F.min("root").alias("root")).join(whole.filter(f"size <= {2 * BLOCK}"), "sid").select(F.col("whole").alias("meet"), "sid", "root")
    apart = met.select("meet", "sid", "root").join(whole.filter(f"size > {2 * BLOCK}").select("sid"), "sid", "left_semi")
    return one.unionByName(apart)


class _Overlaps:
    """Exact intersection sizes of sets, from bitmaps over the tokens that several of them have."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        token, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(seen > 1) - 1
        shared = seen[at] > 1
        row, col = np.repeat(np.arange(len(sets)), size)[shared], number[at[shared]]
        self.sets, words = sets, -(-int((seen > 1).sum()) // 64)
        self.bits = None
        if len(sets) * words <= _EXACT_WORDS:
            self.bits = np.zeros((len(sets), words), np.uint64)
            np.bitwise_or.at(self.bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        return np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)


def _joined(met: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: links that connect the sets of each meeting as all its links do, of rows ``meet, sid, root, body``; a set fewer at most."""
    keys = ("meet",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_keys(batches, keys):
            sid, root, body = x["sid"].to_numpy(), x["root"].to_numpy(), x["body"].combine_chunks()
            found: list[tuple[int, int]] = []
            for lo, hi in _spans(x, keys):
                sets = [np.frombuffer(body[k].as_buffer(), np.uint64) for k in range(lo, hi)]
                order = np.lexsort((sid[lo:hi], [len(s) for s in sets]))
                sets = [sets[k] for k in order.tolist()]
                n = np.array([len(s) for s in sets])
                names, label = sid[lo:hi][order], root[lo:hi][order].copy()
                common = _Overlaps(sets)
                bits = np.stack([bitmap(s) for s in sets]).view(np.uint64)
                for a, b in Tree(bits, n).pairs(num, den, label):  # sees labels as they join
                    step = 4096 if common.bits is None else max(64, (1 << 18) // (common.bits.shape[1] + 1))
                    for at in range(0, len(a), step):
                        p, q = a[at : at + step], b[at : at + step]
                        apart = label[p] != label[q]
                        p, q = p[apart], q[apart]
                        both = common(p, q)
                        link = den * both >= num * (n[p] + n[q] - both)
                        found += [(int(names[u]), int(names[v])) for u, v in _forest(p[link], q[link], label)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        give_back()

    return met.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that truly link."""
    x = sets.select(F.col("sid").alias("a"), F.col("body").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("body").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _several(rows: DataFrame) -> DataFrame:
    """Rows whose token two sets or more have; the sets of a hot token meet as one row a task."""
    tokens = rows.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("token")
    return rows.join(few(materialize(tokens, "jaccard-tokens")), "token")


def _place() -> Column:
    return F.struct(F.xxhash64("__file", "__row").alias("x"), F.xxhash64("__row", "__file").alias("y"))


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(rows, edges)``: ``doc_id, loc, n, sid`` of every row, and linked set pairs ``a, b`` that give the same components as all links."""
    ship_package(docs.sparkSession)
    src = located(file_backed(docs))
    rows = src.select(
        pick(src, id_col).cast("long").alias("doc_id"), _place().alias("loc"), pick(src, text_col).cast("string").alias("t")
    )
    seen = materialize(_read(rows, k), "jaccard-seen")
    level = docs.sparkSession.sparkContext.broadcast(_levels(seen))
    seen = seen.filter("chunk IS NULL").drop("chunk", "counts")

    heads = materialize(_prefixes(rows, k, level, num, den), "jaccard-prefixes")
    level.destroy()  # the rows are written; the driver's copy goes too
    shared = materialize(_several(heads).distinct(), "jaccard-shards")
    least = f"({num} * m + {den - 1}) DIV {den}"  # the smallest set that may link to one of m elements; its count is what a link promises
    for _ in range(_PEELS):
        enough = shared.groupBy("sid").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("m")).filter(f"c >= 1 + ({least}) DIV {_EACH}").select("sid")
        enough = materialize(enough, "jaccard-enough")
        shared = materialize(_several(shared.join(few(enough), "sid")), "jaccard-shards")

    reps = seen.groupBy("sid").agg(F.min("loc").alias("loc")).join(few(materialize(shared.select("sid").distinct(), "jaccard-sids")), "sid", "left_semi")
    near_reps = few(materialize(reps.select("loc"), "jaccard-reps"))
    sets = materialize(_candidates(rows.join(near_reps, "loc", "left_semi"), k), "jaccard-sets")

    # near copies: each set with the first one, in a seeded order, of its shard and size band; the most promising of them
    signs = sets.select("sid", "bits")
    banded = shared.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.08))))
    near = rooted = None
    for seed in range(_ROUNDS):
        first = banded.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("sid", F.lit(seed)).alias("h"), F.col("sid"))).alias("f"))
        first = first.select("token", "band", F.col("f.sid").alias("b"))
        star = banded.join(first, ["token", "band"]).filter("sid <> b").groupBy(F.col("sid").alias("a"), "b").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"))
        star = star.filter(f"votes > n DIV {2 * _EACH}")
        if rooted is not None:  # groups that have met need no more links
            ends = {c: group.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"}
            star = star.join(few(ends["a"], count), "a", "left").join(few(ends["b"], count), "b", "left")
            star = star.filter("coalesce(ra, a) <> coalesce(rb, b)")
        best = star.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        found = materialize(_verified(best, sets, num, den), "jaccard-near")
        near = found if near is None else near.unionByName(found)
        group = materialize(components(near), "jaccard-groups")
        count = group.count()
        rooted = shared.join(few(group.withColumnRenamed("id", "sid"), count), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    # signature trees over shards that span several groups
    rooted = materialize(rooted, "jaccard-rooted")
    wide = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rooted.join(wide.select("token", blocks.alias("blocks")), "token").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(signs, "sid")
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "n", "bits", "root")
    shards = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    met = materialize(_gathered(materialize(_meetings(shards, num, den), "jaccard-meetings")), "jaccard-gathered").join(sets.select("sid", "body"), "sid")
    rest = _joined(met.repartition("meet").sortWithinPartitions("meet").select("meet", "sid", "root", "body"), num, den)
    return seen, materialize(near.unionByName(rest), "jaccard-links")


def report(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    seen, edges = links(docs, **kw)
    roots = components(edges).select(F.col("id").alias("sid"), "root")
    named = seen.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = named.filter("n > 0").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(named.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_each(docs: DataFrame, **kw) -> DataFrame:
    """One row of each component stays (the least identifier, then place), with the columns of ``docs``."""
    docs = file_backed(docs)
    seen, edges = links(docs, **kw)
    roots = components(edges).select(F.col("id").alias("sid"), "root")
    named = seen.filter("n > 0").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "loc")).alias("m")).select("m.loc")
    stays = stays.unionByName(seen.filter("n = 0").select("loc")).withColumnRenamed("loc", "__loc")
    src = placed(docs).withColumn("__loc", _place())
    return src.join(stays, "__loc", "left_semi").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
