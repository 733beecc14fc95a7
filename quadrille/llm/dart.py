"""MinHash near-dedup with DartMinHash signatures.

Darts are a Poisson process of unit intensity over (element, weight, rank),
drawn from hashes so that every document meets the same darts. A document's
region is, for each of its shingles, the weights below the shingle's times ranks
up to ``t / total weight``; it is covered by cells, dyadic along both axes, and a
dart of a cell counts if it lies in the region. So the work is about t = k ln k +
2k darts a document and a few cells an element, however large the weights, which
are any positive numbers. Each dart names one of k coordinates, and the earliest
per coordinate is the signature.

Signatures are banded; a bucket links its members to one leader (no pairs within
a bucket), links are verified on the whole shingle sets, and buckets that still
hold several components afterwards are searched across components, so that no
candidate link between different classes is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, filed, located, remove, returning, slices, staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Share of equal coordinates under which a pair can't be similar enough: about 6 standard deviations below SIMILARITY at 120 coordinates.
SKETCH_FLOOR = 0.58
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Upper ends of the rank cells.
CELLS = [0.25, *(float(1 << i) for i in range(0, 40))]

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _salt(*parts: int) -> np.uint64:
    return U(xxhash.xxh64_intdigest(repr(parts).encode()))


class TokenHashes(dict):
    """64-bit hash by word; emptied when it holds ``most`` words."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, cache: TokenHashes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``width`` words (lower-cased letters, digits and non-ASCII); fewer words are one shingle; none for no word."""
    words = text.translate(TABLE).split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(cache.__getitem__, words), U, n)
    span = min(width, n)
    out = np.full(n - span + 1, U(span))
    for j in range(span):
        out = (out ^ h[j : n - span + 1 + j]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return out


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events."""
    top = int(mean + 12 * math.sqrt(mean) + 12)
    logs = -mean + np.arange(top) * math.log(mean) - np.array([math.lgamma(i + 1) for i in range(top)])
    return np.cumsum(np.exp(logs))


_TABLES: dict[int, np.ndarray] = {}


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, counts: np.ndarray, k: int) -> np.ndarray:
    """Signatures (documents x k, as 64-bit patterns of the earliest ranks) of weighted sets.

    ``elements`` and their positive ``weights`` (1 where None) lie one document
    after another, ``counts`` elements each, all above 0. Equal ranks mean equal
    darts; the share of equal coordinates estimates the sum of the lesser weights
    over the sum of the greater.
    """
    docs = np.repeat(np.arange(len(counts)), counts)
    weights = np.ones(len(elements)) if weights is None else weights.astype(float)
    total = np.bincount(docs, weights, minlength=len(counts))
    limit = (k * math.log(k) + 2 * k) / total
    sig = np.full(len(counts) * k, np.inf)
    while True:
        low, high = 0.0, 1.0
        chosen = np.arange(len(elements))
        while len(chosen):  # weight cells [0, 1), [1, 2), [2, 4), ...
            _throw(elements[chosen], docs[chosen], weights[chosen], limit, sig, k, low, high)
            chosen = chosen[weights[chosen] > high]
            low, high = high, high * 2
        left = np.isinf(sig.reshape(-1, k)).any(axis=1)
        if not left.any():
            return sig.reshape(-1, k).view(U)
        # some coordinate had no dart: these documents look twice as far
        keep = left[docs]
        elements, docs, weights = elements[keep], docs[keep], weights[keep]
        limit = np.where(left, limit * 2, limit)


def _throw(elements: np.ndarray, docs: np.ndarray, weights: np.ndarray, limit: np.ndarray, sig: np.ndarray, k: int, least: float, most: float) -> None:
    """Throw the darts of the weight cell [least, most); its rank cells are the narrower the wider it is."""
    reach, low = limit[docs], 0.0
    for cell, end in enumerate(CELLS):
        high = end / (most - least)
        met = reach > low
        if not met.any():
            return
        if not met.all():
            elements, docs, weights, reach = elements[met], docs[met], weights[met], reach[met]
        if cell not in _TABLES:  # the area of a cell depends on its number alone
            _TABLES[cell] = _poisson_table(end - (CELLS[cell - 1] if cell else 0.0))
        seeds = mix(elements ^ _salt(cell, int(most)))
        n = np.searchsorted(_TABLES[cell], (seeds >> U(11)) * 2.0**-53, side="right")
        some = np.flatnonzero(n)
        n = n[some]
        which = np.repeat(some, n)
        nth = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)).astype(U)
        h = mix(seeds[which] + (nth + U(1)) * U(0x9E3779B97F4A7C15))
        rank = low + (high - low) * ((h >> U(11)) * 2.0**-53)
        near = rank <= reach[which]
        h, which, rank = h[near], which[near], rank[near]
        h = mix(h)
        coordinate = ((h >> U(40)) * U(k) >> U(24)).astype(np.int64)
        inside = least + (most - least) * ((h & U((1 << 40) - 1)) * 2.0**-40) < weights[which]
        np.minimum.at(sig, docs[which[inside]] * k + coordinate[inside], rank[inside])
        low = high


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), U)
    for b in range(bands):
        h = np.full(len(sig), _salt(b, rows))
        for r in range(rows):
            h = mix(h ^ sig[:, b * rows + r])
        out[:, b] = h
    return out


#: Weights of a document's distinct shingles from the shingles and their numbers of occurrences; None: all weigh 1.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts


def _sets(texts: list[bytes], cache: TokenHashes, width: int, weigh: Weigh | None) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    if weigh is None:
        return [np.unique(shingles(t, cache, width)) for t in texts], None
    both = [np.unique(shingles(t, cache, width), return_counts=True) for t in texts]
    return [x for x, _ in both], [np.asarray(weigh(x, n), float) for x, n in both]


def signatures(rows: DataFrame, width: int, bands: int, rows_: int, weigh: Weigh | None) -> DataFrame:
    """(_id, _loc, cls, n, bands, sketch) of (_id, _loc, _text): cls names the weighted shingle set, n is its total weight; documents without words have null cls."""
    k = bands * rows_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for batch in batches:
            texts = byte_texts(batch.column(2))
            for i, j in slices(texts, 1 << 19):
                sets, counts = _sets(texts[i:j], cache, width, weigh)
                full = [x for x in range(j - i) if len(sets[x])]
                cls: list[bytes | None] = [None] * (j - i)
                keys: list[list[int] | None] = [None] * (j - i)
                sketch: list[bytes | None] = [None] * (j - i)
                sizes = np.zeros(j - i)
                if full:
                    weights = np.concatenate([counts[x] for x in full]) if counts else None
                    sig = dart_signatures(np.concatenate([sets[x] for x in full]), weights, np.array([len(sets[x]) for x in full]), k)
                    banded = bands_of(sig, bands, rows_).view(np.int64)
                    bytes_ = (mix(sig) >> U(56)).astype(np.uint8)
                    for at, x in enumerate(full):
                        whole = sets[x].tobytes() + (counts[x].tobytes() if counts else b"")
                        cls[x] = hashlib.blake2b(whole, digest_size=16).digest()
                        keys[x], sketch[x] = banded[at], bytes_[at].tobytes()
                        sizes[x] = counts[x].sum() if counts else len(sets[x])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(cls, pa.binary()), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["_id", "_loc", "cls", "n", "bands", "sketch"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_loc", "_text").mapInArrow(returning(run), f"_id {kind}, _loc string, cls binary, n double, bands array<bigint>, sketch binary")


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray | None = None, nb: np.ndarray | None = None) -> float:
    """Jaccard similarity of two sorted sets, weighted where counts are given."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if na is None:
        both, sizes = len(ia), len(a) + len(b)
    else:
        both, sizes = np.minimum(na[ia], nb[ib]).sum(), na.sum() + nb.sum()
    return both / (sizes - both) if sizes > both else 1.0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, weigh: Weigh | None) -> DataFrame:
    """(a, b) of ``pairs`` whose classes are similar enough; ``texts``: (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for batch in batches:
            keep, last = [], (None, None)
            xs, ys = byte_texts(batch.column(2)), byte_texts(batch.column(3))
            for i, (x, y) in enumerate(zip(xs, ys)):
                if last[0] != y:
                    last = (y, _sets([y], cache, width, weigh))
                sets, counts = _sets([x], cache, width, weigh)
                other, weights = last[1]
                if similarity(sets[0], other[0], counts and counts[0], weights and weights[0]) >= threshold:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(returning(run), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the least node of each component. Label spreading with pointer jumping; each round is a table in the shared folder."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v").distinct(), "components-edges")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "components-0")
    spark = edges.sparkSession
    while True:
        near = both.join(labels.toDF("v", "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
        spread = labels.join(near.toDF("node", "l"), "node", "left").select("node", F.least("label", F.coalesce("l", "label")).alias("to"), "label")
        jump = spread.join(labels.toDF("to", "further"), "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), (F.least("to", F.coalesce("further", "to")) != F.col("label")).alias("moved"))
        after = staged(jump, "components")
        moved = not after.filter("moved").isEmpty()
        remove(spark, labels)
        labels = after.select("node", "label")
        if not moved:
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weigh: Weigh | None = occurrences
) -> DataFrame:
    """One row per document: id, class_id, class_size, kept, n_shingles, set_id, locator.

    Classes are the connected components of the links between documents whose
    ``width``-word shingles, weighted by ``weigh`` (by default each by how often it
    occurs), have a Jaccard similarity, lesser over greater weights, of at least
    ``threshold``; class_id is the smallest id in the
    class, and its row (of repeated rows the first stored) is ``kept``. n_shingles is the total weight. Equal
    weighted sets are one set_id and aren't paired. Null, empty and wordless
    texts stay alone; null ids sort first; an empty table gives no rows; columns
    not named aren't read.
    """
    docs = filed(docs, "neardup-input")
    source = located(docs, _id=docs[id_col], _text=docs[text_col])
    signed = staged(signatures(source, width, bands, rows, weigh), "neardup-signed")
    classes = signed.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("_id", "_loc")).alias("rep"), F.min(F.struct("n", "bands", "sketch")).alias("s"))
    classes = staged(classes.select("cls", "rep", "s.n", "s.bands", "s.sketch"), "neardup-classes")

    members = classes.select("cls", "n", F.explode("bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    sized = F.least(F.col("n"), F.col("m")) >= F.lit(threshold) * F.greatest(F.col("n"), F.col("m"))
    pairs = members.join(leaders, "key").select(F.col("cls").alias("a"), "n", F.col("lead.cls").alias("b"), F.col("lead.n").alias("m")).filter("a <> b").filter(sized)
    pairs = staged(pairs.select("a", "b").distinct(), "neardup-pairs")
    texts = _texts(pairs, classes, source)
    edges = staged(verified(pairs, texts, threshold, width, weigh), "neardup-links")
    labels = components(edges)

    # buckets that hold several components: every pair across components is still to be tried
    named = members.join(labels.toDF("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    open_ = staged(named.join(mixed, "key", "left_semi"), "neardup-open")
    # equal runs of members occur in many buckets; pairs are distinct before sketches are compared
    left, right = open_.toDF("key", "a", "n", "la"), open_.toDF("key", "b", "m", "lb")
    across = left.join(right, "key").filter("a < b and la <> lb").filter(sized).select("a", "b").distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = across.join(tried, ["a", "b"], "left_anti")
    across = staged(_sketched(across, classes, threshold), "neardup-across")
    if not across.isEmpty():
        more = verified(across, _texts(across, classes, source), threshold, width, weigh)
        edges = staged(edges.union(more), "neardup-links")
        labels = components(edges)

    out = signed.drop("bands", "sketch").join(labels.toDF("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    heads = out.filter("label is not null").groupBy("label").agg(F.min(F.struct("_id", "_loc")).alias("head"), F.count(F.lit(1)).alias("size"))
    out = out.join(heads, "label", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("label").isNull(), F.col("_id")).otherwise(F.col("head._id")).alias("class_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("head._loc") == F.col("_loc"), F.lit(True)).alias("kept"),
        F.col("n").alias("n_shingles"),
        F.lower(F.hex("cls")).alias("set_id"),
        F.col("_loc").alias("locator"),
    )


def _texts(pairs: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """(cls, text) of one document of each class in ``pairs``, staged."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes.select("cls", F.col("rep._loc").alias("_loc")), "cls")
    return staged(source.select("_loc", F.col("_text").alias("text")).join(needed, "_loc").select("cls", "text"), "neardup-texts")


def _sketched(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` whose sketches agree often enough to be worth reading the texts."""
    floor = SKETCH_FLOOR / SIMILARITY * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                good = (x == y).mean(axis=1) >= floor
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in (0, 1)], ["a", "b"])

    a, b = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("sa")), classes.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(returning(run), "a binary, b binary")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class; same columns.

    Null, empty and wordless texts all stay; of repeated rows the first stored
    stays; null ids sort first; texts of any length are read whole; an empty table
    gives no rows; extra columns, of whatever names, are carried along.
    """
    docs = filed(docs, "neardup-input")
    names = docs.columns
    rows = located(docs, **{f"_c{i}": docs[c] for i, c in enumerate(names)})
    bad = near_duplicates(docs, **options).filter("not kept").select(F.col("locator").alias("_loc"))
    return rows.join(bad, "_loc", "left_anti").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
