"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts of all training tokens are one distributed table. The neural model
predicts a token's class from its two predecessors: the most frequent words are
classes of their own, the others share classes by their last two bytes, and a word has its
smoothed relative frequency inside its class, so token probabilities are
normalised over all words, unseen ones included. Every partition of the training
documents runs numpy NCE from one warm start and the parameters are averaged by
tokens; batched matrix products then give the exact normaliser of every context.

Documents are scored in one pass. Frequent words (``HEAD``, a fixed bound) are
looked up in a broadcast; all rarer ones go as (document, word, n) rows to a join
with the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices, staged

HEAD = 300_000
OWN, SHARED, DIM = 384, 128, 16
NOISE, BATCH, RATE = 24, 2048, 0.1
#: Warm start: at most so many training documents, the first by hash of the id.
WARM_DOCS = 1_000
WARM_CHARS = 20_000
#: The end of a text; no word is empty.
END = b""
SMOOTH = 0.1


def shared_class(word: bytes) -> int:
    """Class of a word that has none of its own."""
    return OWN + (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 7) % SHARED if word else OWN


class Codes(dict):
    """word -> rank below ``head`` for frequent words, else head + class."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.head = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.head + shared_class(word)


class Lbl:
    """score(class | a, b) = (left[a] + near[b]) . out[class] + bias[class], a being two tokens back."""

    def __init__(self, classes: int, noise: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.start = classes, classes
        self.noise = noise
        init = lambda n: (rng.standard_normal((n, DIM)) * 0.1).astype(np.float32)
        self.left, self.near, self.out = init(classes + 1), init(classes + 1), init(classes)
        self.bias = np.log(noise).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.left, self.near, self.out, self.bias[:, None]]

    def load(self, rows: np.ndarray) -> None:
        n = self.classes
        self.left, self.near = rows[: n + 1, :DIM].copy(), rows[n + 1 : 2 * n + 2, :DIM].copy()
        self.out, self.bias = rows[2 * n + 2 : 3 * n + 2, :DIM].copy(), rows[3 * n + 2 :, 0].copy()

    def dump(self) -> np.ndarray:
        return np.concatenate([np.pad(p, ((0, 0), (0, DIM - p.shape[1]))) for p in self.parameters()]).astype(np.float32)

    def fit(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, rng: np.random.Generator, memory: list[np.ndarray]) -> None:
        """One NCE pass by Adagrad over contexts (a, b) and classes c; ``memory`` holds the squared gradients."""
        shift = np.log(NOISE * self.noise).astype(np.float32)
        drawn = rng.choice(self.classes, (len(c) // BATCH + 1, NOISE), p=self.noise)
        for i, start in enumerate(range(0, len(c), BATCH)):
            x, y, w = a[start : start + BATCH], b[start : start + BATCH], c[start : start + BATCH]
            q, t = self.left[x] + self.near[y], self.out[w]
            true = np.einsum("ij,ij->i", q, t) + self.bias[w] - shift[w]
            z = drawn[i]
            tz = self.out[z]
            false = q @ tz.T + (self.bias[z] - shift[z])
            gt = 1.0 - 1.0 / (1.0 + np.exp(-true))
            gf = -1.0 / (1.0 + np.exp(-false))
            dq = gt[:, None] * t + gf @ tz
            self._add(self.left, memory[0], x, dq)
            self._add(self.near, memory[1], y, dq)
            self._add(self.out, memory[2], np.concatenate([w, z]), np.concatenate([gt[:, None] * q, gf.T @ q]))
            self._add(self.bias[:, None], memory[3], np.concatenate([w, z]), np.concatenate([gt, gf.sum(axis=0)])[:, None])

    @staticmethod
    def _add(p: np.ndarray, m: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g, rows = np.add.reduceat(grad[order], at), rows[at]
        m[rows] += g * g
        p[rows] += RATE * g / np.sqrt(m[rows])

    def memory(self) -> list[np.ndarray]:
        return [np.full(p.shape, 1.0, np.float32) for p in self.parameters()]

    def normalisers(self) -> np.ndarray:
        """log Z of every context (a, b), by batched matrix products."""
        n = self.classes + 1
        out = np.empty((n, n), np.float32)
        near = self.near @ self.out.T + self.bias
        for a in range(n):
            s = near + self.left[a] @ self.out.T
            top = s.max(axis=1)
            out[a] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out.ravel()


def contexts(classes: np.ndarray, counts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes two and one tokens before each token; texts begin with two start marks."""
    begins = np.cumsum(counts) - counts
    a, b = np.roll(classes, 2), np.roll(classes, 1)
    a[begins] = b[begins] = start
    a[begins[counts > 1] + 1] = start
    return a, b


def encode(texts: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Codes of all tokens (with ends), number of tokens of each text, and its words."""
    flat: list[int] = []
    words = [t.lower().split() for t in texts]
    end = codes[END]
    for ws in words:
        flat.extend(map(codes.__getitem__, ws))
        flat.append(end)
    return np.array(flat, np.int64), np.array([len(ws) + 1 for ws in words], np.int64), words


class Vocabulary:
    """What scoring knows of the counts: the frequent words, and totals in all and by class."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, class_n: np.ndarray, class_v: np.ndarray):
        self.words = [w for w, _ in head]
        counts = np.array([c for _, c in head], float)
        self.total, self.distinct = total, distinct
        n = len(head)
        own = np.array([i if i < OWN else shared_class(w) for i, w in enumerate(self.words)], np.int64) if n else np.empty(0, np.int64)
        self.class_of = np.concatenate([own, np.arange(OWN + SHARED)])
        self.class_log = np.log10(class_n + SMOOTH * (class_v + 1))
        self.base_log = float(np.log10(total + SMOOTH * (distinct + 1)))
        inside = np.log10(counts + SMOOTH) - self.class_log[own] if n else np.empty(0)
        inside[: min(OWN, n)] = 0.0
        self.inside = np.concatenate([inside, np.zeros(OWN + SHARED)])
        self.base = np.concatenate([np.log10(counts + SMOOTH) - self.base_log, np.zeros(OWN + SHARED)])


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return docs.select(docs[id_col].alias("doc_id"), held.alias("held_out"), docs[text_col].alias("text"))


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, c) over the training rows; the end is the empty token. Counted a slice at a time before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(0))
            for i, j in slices(texts, 8 << 20):
                seen: Counter[bytes] = Counter()
                for t in texts[i:j]:
                    seen.update(t.lower().split())
                seen[END] += j - i
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

    return rows.filter("not held_out").select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int) -> Vocabulary:
    # the least count that leaves at most ``head`` words above it: no global sort, whatever the vocabulary
    least, above = 0, 0
    for c, n in sorted(((r[0], r[1]) for r in counts.groupBy("c").count().collect()), reverse=True):
        above += n
        if above > head:
            least = c
            break
    found = counts.filter(F.col("c") > least).select("token", "c").toArrow()  # at most ``head`` rows
    top = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))
    own = {w for w, _ in top[:OWN]}
    shared = counts.sparkSession.sparkContext.broadcast(own)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(OWN + SHARED), np.zeros(OWN + SHARED)
        for batch in batches:
            words = batch.column(0).to_pylist()
            c = batch.column(1).to_numpy(zero_copy_only=False)
            cls = np.array([0 if w in shared.value else shared_class(w) for w in words], np.int64)
            n += np.bincount(cls, c, OWN + SHARED)
            v += np.bincount(cls, minlength=OWN + SHARED)
        yield pa.RecordBatch.from_arrays([pa.array(range(OWN + SHARED)), pa.array(n), pa.array(v)], ["cls", "n", "v"])

    n, v = np.zeros(OWN + SHARED), np.zeros(OWN + SHARED)
    for r in counts.mapInArrow(by_class, "cls long, n double, v double").groupBy("cls").agg(F.sum("n"), F.sum("v")).collect():  # a row a class
        n[r[0]], v[r[0]] = r[1], r[2]
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    return Vocabulary(top, total or 0, distinct, n, v)


def _noise(vocab: Vocabulary) -> np.ndarray:
    own = 10.0 ** vocab.base[: min(OWN, len(vocab.words))]
    q = np.full(OWN + SHARED, 1e-7)
    q[: len(own)] += own
    q[OWN:] += 10.0 ** (vocab.class_log[OWN:] - vocab.base_log)
    return q / q.sum()


def train(rows: DataFrame, vocab: Vocabulary, warm_docs: int = WARM_DOCS) -> Lbl:
    """Warm start on a bounded sample, then one NCE pass of every partition over its training documents, averaged by tokens."""
    model = Lbl(OWN + SHARED, _noise(vocab))
    codes = Codes(vocab.words)
    training = rows.filter("not held_out")
    # ids first, so that no texts are sorted; then at most warm_docs texts of at most WARM_CHARS
    ids = training.filter(F.length("text") <= WARM_CHARS).select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(warm_docs)
    ids = staged(ids, "lm-warm")
    sample = [(r[0] or "").encode() for r in training.filter(F.length("text") <= WARM_CHARS).join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("_id"), "left_semi").select("text").collect()]
    memory, rng = model.memory(), np.random.default_rng(1)
    if not sample:
        return model
    for i, j in slices(sample, 4 << 20):
        flat, counts, _ = encode(sample[i:j], codes)
        cls = vocab.class_of[flat]
        a, b = contexts(cls, counts, model.start)
        for _ in range(2):
            model.fit(a, b, cls, rng, memory)
    shared = rows.sparkSession.sparkContext.broadcast((model.dump(), [m.copy() for m in memory], vocab, model.noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, memory, vocab, noise = shared.value
        mine, codes, tokens = Lbl(OWN + SHARED, noise), Codes(vocab.words), 0
        mine.load(start)
        memory, rng = [m.copy() for m in memory], np.random.default_rng(2)
        for batch in batches:
            texts = byte_texts(batch.column(0))
            for i, j in slices(texts):
                flat, counts, _ = encode(texts[i:j], codes)
                cls = vocab.class_of[flat]
                a, b = contexts(cls, counts, mine.start)
                mine.fit(a, b, cls, rng, memory)
                tokens += len(cls)
        if tokens:
            rows = mine.dump()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(tokens))), pa.array(list(rows), pa.list_(pa.float32()))], ["row", "n", "vec"])

    parts = training.select("text").mapInArrow(run, "row int, n double, vec array<float>")
    sums = parts.select("row", "n", F.posexplode("vec").alias("at", "v")).groupBy("row", "at").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
    found = sums.toPandas()  # as many rows as the model has parameters
    dense = model.dump()
    dense[found["row"].to_numpy(), found["at"].to_numpy()] = found["v"].to_numpy()
    model.load(dense)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, warm_docs: int = WARM_DOCS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32(id as text) modulo 10 isn't 0.
    Null texts count as empty (one token, the end), null ids as ''. Without
    training documents every token is unseen. Repeated rows get a row each; an
    empty table gives no rows; columns not named aren't read.
    """
    spark = docs.sparkSession
    rows = _docs(docs, id_col, text_col)
    counts = staged(token_counts(rows), "lm-counts")
    vocab = vocabulary(counts, head)
    model = train(rows, vocab, warm_docs)
    shared = spark.sparkContext.broadcast((model, model.normalisers(), vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_z, vocab = shared.value
        codes, head = Codes(vocab.words), len(vocab.words)
        log_out = float(np.log10(np.e))
        for batch in batches:
            texts = byte_texts(batch.column(3))
            for i, j in slices(texts):
                flat, counts, words = encode(texts[i:j], codes)
                cls = vocab.class_of[flat]
                a, b = contexts(cls, counts, model.start)
                logs = np.einsum("ij,ij->i", model.left[a] + model.near[b], model.out[cls]) + model.bias[cls] - log_z[a * (model.classes + 1) + b]
                logs = logs.astype(float) * log_out + vocab.inside[flat]
                begins = np.cumsum(counts) - counts
                rare = flat >= head
                n = j - i
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), batch.column(1).slice(i, n), batch.column(2).slice(i, n), pa.array(counts), pa.array(counts - np.add.reduceat(rare, begins, dtype=np.int64)),
                     pa.array(np.add.reduceat(vocab.base[flat], begins)), pa.array(np.add.reduceat(logs, begins)), none, pa.nulls(n, pa.int64())],
                    NAMES,
                )
                at = np.flatnonzero(rare)
                if len(at):
                    owner = np.searchsorted(begins, at, side="right") - 1
                    seen = Counter(zip(owner.tolist(), [words[o][p] if p < len(words[o]) else END for o, p in zip(owner.tolist(), (at - begins[owner]).tolist())]))
                    n = len(seen)
                    uids = batch.column(0).slice(i, j - i).take(pa.array([o for o, _ in seen], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [uids, pa.nulls(n, batch.column(1).type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()),
                         pa.array([w for _, w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                        NAMES,
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lm double, token binary, n long"
    both = staged(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(run, schema), "lm-scores")

    # words outside the broadcast: counts come by a join on the word
    last, before = F.conv(F.hex(F.substring("token", -1, 1)), 16, 10).cast("int"), F.conv(F.hex(F.expr("substring(token, -2, 1)")), 16, 10).cast("int")
    shared_of = F.lit(OWN) + (last * 31 + F.when(F.octet_length("token") > 1, before).otherwise(0) * 7) % F.lit(SHARED)
    cls = F.when(F.octet_length("token") == 0, F.lit(OWN)).otherwise(shared_of)
    class_log = F.element_at(F.array(*[F.lit(float(x)) for x in vocab.class_log]), cls + 1)
    rare = both.filter("token is not null").select("uid", "token", "n").join(counts, "token", "left")
    part = F.log10(F.coalesce(F.col("c").cast("double"), F.lit(0.0)) + F.lit(SMOOTH))
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * (part - F.lit(vocab.base_log))).alias("b"),
        F.sum(F.col("n") * (part - class_log)).alias("l"),
    )
    out = both.filter("token is null").join(rare, "uid", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("lm") + F.coalesce("l", F.lit(0.0))).alias("score"),
    )


NAMES = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "token", "n"]
