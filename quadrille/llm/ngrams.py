"""Kneser-Ney counts and scores of any number of trigrams, sharded by the middle word.

Everything that the probability of a trigram (a, b, c) needs, except the continuation
count of c, is a matter of trigrams with the same b. So tokens are exchanged to shards by
b, and a shard counts the trigrams of its training tokens and scores all of its tokens.
Frequent words are spread over several shards by a; their bigram counts are then summed
over shards and sent to each. Words are told apart by 64-bit hashes (BLAKE2b) and numbered
by their frequency in training; others share a number. Tokens travel in packed blocks, one
a batch of texts and shard, in ``ROUNDS`` exchanges of a part of the shards each, whose
files go before the next. Tasks get their rows in batches of about a block's bytes, however
long the texts are. Only hashes, numbers and continuation counts of training words
(16 bytes a word) and the keys of training rows (8 bytes each) are broadcast. Logs are
summed in fixed point: results don't depend on the layout.
"""

from __future__ import annotations

import pickle
from array import array
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, returning, slices, staged

#: Bytes of text to a shard, and the exchanges that scoring takes.
SHARD_BYTES = 16 << 20
ROUNDS = 2
#: Texts to a packed block, in bytes.
BLOCK_BYTES = 8 << 20
#: Tokens whose shards are found at once.
PIECE = 1 << 17
#: One row in so many tells which words are frequent, which decides on the layout only.
LAYOUT_ROWS = 16
#: Steps of the fixed-point logs to one.
STEPS = float(1 << 30)
UNK, START, END, FIRST = 0, 1, 2, 3


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words, after two for the marks; every token as an index into them; and the tokens of each text (the end counts as one)."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    known[b" start"], known[b" end"]  # noqa: B018 - indices 0 and 1; no word holds a space
    ids = array("i")
    counts = np.empty(len(texts), np.int64)
    get = known.__getitem__
    for i, t in enumerate(texts):
        words = t.split()
        ids.extend(map(get, words))
        ids.append(1)
        counts[i] = len(words) + 1
    known.default_factory = None  # a cycle: the words would stay until Python happens to collect its garbage
    hashes = bytearray()
    for w in known:
        hashes += blake2b(w, digest_size=8).digest()
    return np.frombuffer(hashes, "<i8").astype(np.int64), np.frombuffer(ids, np.int32), counts


def _tokens(texts: list[bytes], vocabulary: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers a, b, c of every token and the two before it, and the tokens of each text. vocabulary: sorted hashes and their numbers."""
    hashes, ids, counts = _words(texts)
    at = _at(vocabulary[0], hashes)
    numbers = np.where(at >= 0, vocabulary[1][at], UNK).astype(np.int32) if len(vocabulary[0]) else np.full(len(hashes), UNK, np.int32)
    numbers[:2] = START, END
    c = numbers[ids]
    del ids
    begins = np.cumsum(counts) - counts
    b, a = np.roll(c, 1), np.roll(c, 2)
    b[begins] = START
    a[begins] = START
    a[begins[counts > 1] + 1] = START
    return a, b, c, counts


class Layout:
    """Shards of tokens: by b, and by a as well where b is one of the frequent words ``hot`` (sorted numbers), over ``spread`` shards."""

    def __init__(self, shards: int, hot: np.ndarray, spread: np.ndarray):
        self.shards, self.hot, self.spread = shards, hot, spread

    def spreads(self, b: np.ndarray) -> np.ndarray:
        at = _at(self.hot, b)
        return np.where(at >= 0, self.spread[at], 1) if len(self.hot) else np.ones(len(b), np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shard = b % self.shards
        for i in range(0, len(b), PIECE):
            spread = self.spreads(b[i : i + PIECE])
            more = np.flatnonzero(spread > 1)
            salt = (a[i + more].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % spread[more]
            shard[i + more] = (shard[i + more] + salt) % self.shards
        return shard


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them, byte by byte, compressed."""
    out = []
    for x in arrays:
        if x.dtype != np.int64 or (len(x) and 0 <= x.min() and x.max() < 1 << 32):
            x = x.astype(np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.uint32)
        raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
        out.append((x.dtype.str, len(raw), pa.compress(raw, "zstd", asbytes=True)))
    return pickle.dumps(out, 5)


def _opened(block: bytes) -> list[np.ndarray]:
    found = []
    for kind, size, raw in pickle.loads(block):  # noqa: S301 - written by _packed in the same job
        x = np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), np.uint8)
        width = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(x.reshape(width, -1).T).view(kind).reshape(-1).astype(np.int64))
    return found


def _blocks(layout: Layout, vocabulary: tuple, rounds: int, turn: int, keys: np.ndarray, texts: list[bytes], trains: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(partition, block) of the tokens whose shard has its turn; a block holds a, b, c, and key, tokens and training mark of each text."""
    a, b, c, counts = _tokens(texts, vocabulary)
    shard = layout.of(a, b)
    mine = np.flatnonzero(shard % rounds == turn)
    part = shard[mine] // rounds
    del shard
    order = np.argsort(part.astype(np.int16) if layout.shards < 1 << 15 else part, kind="stable")
    mine, part = mine[order], part[order]
    del order
    # one after the other: all tokens of each go before those of the next are picked
    a = a[mine]
    b = b[mine]
    c = c[mine]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)[mine]
    del mine
    cuts = _starts(part)
    for i, j in zip(cuts, [*cuts[1:], len(part)]):
        at = _starts(doc[i:j])
        docs = doc[i:j][at]
        yield int(part[i]), _packed(a[i:j], b[i:j], c[i:j], keys[docs], np.diff(at, append=j - i), trains[docs])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _exchanged(rows: DataFrame, layout: Layout, vocabulary, trained, rounds: int, turn: int, only_trained: bool, hot: DataFrame | None = None) -> DataFrame:
    """(part, hot, block) in the partition of each shard that has its turn. rows: (key, text). hot: (b, c, n) of frequent words b."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            trains = _at(trained.value, keys) >= 0
            if only_trained:
                batch = batch.filter(pa.array(trains))
                keys, trains = keys[trains], trains[trains]
            texts = byte_texts(batch.column(1))
            for i, j in slices(texts, BLOCK_BYTES):
                yield from _as_batch(_blocks(layout, vocabulary.value, rounds, turn, keys[i:j], texts[i:j], trains[i:j].astype(np.int64)), False)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, c, n = (batch.column(k).to_numpy() for k in range(3))
            first, spreads = b % layout.shards, layout.spreads(b)
            out = defaultdict(list)
            for salt in range(int(spreads.max(initial=0))):
                shard = (first + salt) % layout.shards
                go = np.flatnonzero((spreads > salt) & (shard % rounds == turn))
                for s in np.unique(shard[go]):
                    out[int(s) // rounds].append(go[shard[go] == s])
            # a word's salts may share no shard, as no word spreads over more than there are
            yield from _as_batch(((p, _packed(*(x[np.concatenate(at)] for x in (b, c, n)))) for p, at in out.items()), True)

    blocks = rows.mapInArrow(returning(pack), "part int, hot boolean, block binary")
    if hot is not None:
        blocks = blocks.unionAll(hot.mapInArrow(returning(spread), "part int, hot boolean, block binary"))
    return blocks.repartitionById(-(-layout.shards // rounds), F.col("part"))


def _as_batch(blocks, hot: bool) -> Iterator[pa.RecordBatch]:
    parts, data = [], []
    for p, x in blocks:
        parts.append(p)
        data.append(x)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([hot] * len(parts)), pa.array(data, pa.binary())], ["part", "hot", "block"])


class Counts:
    """Trigram counts of a shard's training tokens, and continuation counts of its bigrams. size: one more than the largest number."""

    def __init__(self, blocks: list[bytes], hot: list[bytes], layout: Layout, size: int):
        found = []
        for block in blocks:
            *abc, _, n, trains = _opened(block)
            own = np.repeat(trains, n) > 0
            found.append([x[own] for x in abc])
        a, b, c = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        del found
        # keys stay below 2**63: numbers are less than 2**31, and pairs fewer than the shard's tokens
        a += b * size
        del b
        self.pairs, at = np.unique(a, return_inverse=True)
        del a
        at *= size
        at += c
        del c
        self.three, self.n3 = np.unique(at, return_counts=True)
        del at
        self.two, self.n2 = np.unique(self.pairs[self.three // size] // size * size + self.three % size, return_counts=True)
        if hot:
            table = [np.concatenate(x) for x in zip(*map(_opened, hot))]
            own = layout.spreads(self.two // size) == 1
            two = np.concatenate([self.two[own], table[0] * size + table[1]])
            order = np.argsort(two)
            self.two, self.n2 = two[order], np.concatenate([self.n2[own], table[2]])[order]
        self.b, self.b_of_two = np.unique(self.two // size, return_inverse=True)

    @staticmethod
    def level(h: np.ndarray, histories: int, n: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probabilities, and back-off weights by history (1 where nothing was seen)."""
        total = np.bincount(h, n, histories)
        off = np.select([n == 1, n == 2], d[:2], d[2])
        left = np.bincount(h, off, histories)
        return (n - off) / total[h], np.where(total > 0, left / np.maximum(total, 1), 1.0)


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], list[bytes]]:
    blocks, hot = [], []
    for batch in batches:
        for is_hot, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            (hot if is_hot else blocks).append(block)
    return blocks, hot


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Removes the files of exchanges at the end of each execution, not when the driver happens to collect its garbage, and hands rows to tasks in batches of a block's bytes, by default 64 MB, which executors hold beside their heap and again in Python."""
    # a batch ends with the row that passes the limit; the rest of a block's bytes is for that row, so that it starts no other block
    ours = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK_BYTES * 7 // 8)}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def vocabulary_of(rows: DataFrame, trained) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all words of the training rows of (key, text), and their numbers, by falling frequency from ``FIRST``."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.filter(pa.array(_at(trained.value, batch.column(0).to_numpy()) >= 0)).column(1))
            for i, j in slices(texts, BLOCK_BYTES):
                hashes, ids, _ = _words(texts[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[2:]), pa.array(np.bincount(ids, minlength=len(hashes))[2:])], ["w", "n"])

    found = rows.mapInArrow(returning(tell), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    words = found.orderBy(F.desc("n"), "w").select("w").toArrow().column(0).to_numpy()  # 8 bytes a word
    order = np.argsort(words)
    return words[order], (order + FIRST).astype(np.int32)


def layout_of(rows: DataFrame, vocabulary) -> tuple[Layout, int]:
    """The layout for (key, text), and the rounds."""
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rounds = min(ROUNDS, shards)
    shards = -(-shards // rounds) * rounds

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(0))
            for i, j in slices(texts, BLOCK_BYTES):
                _, b, _, _ = _tokens(texts[i:j], vocabulary.value)
                w, n = np.unique(b, return_counts=True)
                top = np.flatnonzero(n * 4 * shards > len(b))
                # -1: all tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.append(w[top], -1).astype(np.int64)), pa.array(np.append(n[top], len(b)).astype(np.int64))], ["w", "n"])

    some = rows.filter(F.pmod(F.xxhash64("key"), F.lit(LAYOUT_ROWS)) == 0).select("text")
    found = dict(some.mapInArrow(returning(often), "w long, n long").groupBy("w").agg(F.sum("n")).collect())  # at most four words a shard and block
    total = found.pop(-1, 0)
    spread = {w: min(shards, -(-2 * n * shards // total)) for w, n in found.items() if 2 * n * shards > total}
    hot = np.array(sorted(w for w in spread if spread[w] > 1), np.int64)
    return Layout(shards, hot, np.array([spread[int(w)] for w in hot], np.int64)), rounds


def scores(rows: DataFrame, trained: np.ndarray, discounts) -> DataFrame:
    """(key, log_prob, n_tokens) of every row of (key long, text), by interpolated modified Kneser-Ney trigrams of the texts whose keys are in ``trained`` (sorted).

    ``discounts``: D1, D2 and D3+ from the numbers of n-grams seen once to four times.
    Texts are read whole, null counting as empty; no n-gram and no word is left out.
    """
    with _settings(rows.sparkSession):
        return _scores(rows, trained, discounts)


def _scores(rows: DataFrame, trained: np.ndarray, discounts) -> DataFrame:
    spark = rows.sparkSession
    marks = spark.sparkContext.broadcast(trained)
    vocabulary = spark.sparkContext.broadcast(vocabulary_of(rows, marks))
    size = len(vocabulary.value[0]) + FIRST
    layout, rounds = layout_of(rows, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Counts(*_read(batches), layout, size)
        b, c = x.two // size, x.two % size
        salted = layout.spreads(b) > 1
        after, times = np.unique(c[~salted], return_counts=True)
        small = lambda ns: np.bincount(ns[ns <= 4], minlength=5)[1:5]
        for kind, b, c, n in (
            (3, np.zeros(4), np.arange(1, 5), small(x.n3)),
            (2, np.zeros(4), np.arange(1, 5), small(x.n2[~salted])),
            (1, np.zeros(len(after)), after, times),
            (0, b[salted], c[salted], x.n2[salted]),
        ):
            for i in range(0, len(n), 1 << 18):
                j = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[j]), kind, np.int32)), *(pa.array(y[j].astype(np.int64)) for y in (b, c, n))], ["kind", "b", "c", "n"])

    counted = staged(_exchanged(rows, layout, vocabulary, marks, 1, 0, True).mapInArrow(returning(count), "kind int, b long, c long, n long"), "kn-counts")
    hot = staged(counted.filter("kind = 0").groupBy("b", "c").agg(F.sum("n").alias("n")), "kn-frequent")
    seen = {k: defaultdict(int) for k in (1, 2, 3)}
    for r in counted.filter("kind >= 2").groupBy("kind", "c").agg(F.sum("n").alias("n")).collect():
        seen[r.kind][r.c] += r.n
    for r in hot.filter("n <= 4").groupBy("n").count().collect():
        seen[2][r[0]] += r[1]
    ones = counted.filter("kind = 1").select("c", "n").unionAll(hot.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    ones = ones.groupBy("c").agg(F.sum("n").alias("n")).select(F.col("c").cast("int"), "n").toArrow()  # one row a word
    times = np.zeros(size, np.int64)
    times[ones.column(0).to_numpy()] = ones.column(1).to_numpy()
    del ones
    for k, n in zip(*np.unique(times[(times > 0) & (times <= 4)], return_counts=True)):
        seen[1][int(k)] = int(n)
    d1, d2, d3 = (discounts(seen[k]) for k in (1, 2, 3))
    total = max(int(times.sum()), 1)
    one = (times - np.select([times == 0, times == 1, times == 2], [0.0, d1[0], d1[1]], d1[2])) / total
    spare = (1.0 - one.sum()) / size
    del one
    followed = spark.sparkContext.broadcast(times.astype(np.int32) if total < 1 << 31 else times)
    del times

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, table = _read(batches)
        x = Counts(blocks, table, layout, size)
        p3, g3 = x.level(x.three // size, len(x.pairs), x.n3, d3)
        p2, g2 = x.level(x.b_of_two, len(x.b), x.n2, d2)
        p3, g3, p2, g2 = (np.append(y, z) for y, z in ((p3, 0.0), (g3, 1.0), (p2, 0.0), (g2, 1.0)))  # last, at -1: of what wasn't seen
        for block in blocks:
            a, b, c, keys, n, _ = _opened(block)
            after = followed.value[c]
            p1 = (after - np.select([after == 0, after == 1, after == 2], [0.0, d1[0], d1[1]], d1[2])) / total + spare
            pair = _at(x.pairs, b * size + a)
            three = _at(x.three, np.where(pair >= 0, pair * size + c, -1))
            logs = np.log(p3[three] + g3[pair] * (p2[_at(x.two, b * size + c)] + g2[_at(x.b, b)] * p1))
            sums = np.add.reduceat(np.rint(logs * STEPS).astype(np.int64), np.cumsum(n) - n)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums), pa.array(n)], ["key", "s", "n"])

    out = None
    for turn in range(rounds):
        part = _exchanged(rows, layout, vocabulary, marks, rounds, turn, False, hot).mapInArrow(returning(score), "key long, s long, n long")
        part = staged(part.groupBy("key").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "kn-sums")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("key").agg((F.sum("s") / F.lit(STEPS)).alias("log_prob"), F.sum("n").alias("n_tokens"))
