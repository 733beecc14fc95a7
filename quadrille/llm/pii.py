"""Personal data by base patterns and a skip-chain conditional random field.

The CRF's nodes are the tokens of a document that hold a digit or an @; chain
edges join neighbours, skip edges join consecutive tokens of one key (the digits
of a number, the part of an address before the @), however far apart. Loopy
belief propagation over all edges lets a clear occurrence settle the label of an
unclear one. It adds spans; the base spans stay.

Training is piecewise: a logistic node model on hashed features, and counted
transition and agreement tables, fitted in numpy to the base labels of a bounded
sample of documents with the validity features dropped at random, so that
context, shape and repetition carry weight too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, staged

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    # a match can only begin where its run of digits does: no second look at the rest of a long run
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SPARSE = re.compile(rb"[0-9@]")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
WORDLIKE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
FEATURES = 1 << 12
TRAINING_DOCS = 2_000
TRAINING_CHARS = 50_000
LEAST = 0.95
ROUNDS = 8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _good(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in found.split(".")))
    digits = "".join(DIGITS.findall(found))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern in linear time: each has one @, so they come in the order of the @s."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends (a leading + stays)."""
    while start < end and text[start] not in WORDLIKE and text[start] != "+":
        start += 1
    while end > start and text[end - 1] not in WORDLIKE:
        end -= 1
    return start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; leftmost non-overlapping matches of each kind, failing ones dropped without retry."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            out += [(s, k, e) for s, e in emails(text)]
            continue
        if kind == "phone" and "+" not in text:
            continue
        out += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if _good(kind, m[0])]
    return sorted(out)


def key_of(token: str) -> str | None:
    """What repeated mentions of one entity share: the part before an @, or six digits and more."""
    if "@" in token:
        name = token.partition("@")[0].strip("\"'(<[").lower()
        return f"@{name}" if len(name) > 2 else None
    digits = "".join(DIGITS.findall(token))
    return digits if len(digits) > 5 else None


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("/".join(map(str, parts)).encode()) % FEATURES


def _node(text: str, start: int, end: int, before: str, after: str) -> tuple[list[int], list[int]]:
    """Hashed features of a token: shape and context, and validity features apart."""
    token = text[slice(*trimmed(text, start, end))]
    digits = "".join(DIGITS.findall(token))
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", token)))[:24]
    soft = [_hash("bias"), _hash("shape", shape), _hash("n", len(digits)), _hash("dots", token.count(".")), _hash("at", token.count("@")), _hash("plus", token.startswith("+"))]
    soft += [_hash("before", re.sub(r"[0-9]", "0", before.lower())[-12:]), _hash("after", re.sub(r"[0-9]", "0", after.lower())[:12])]
    hard = [_hash("email", bool(PATTERNS["email"].fullmatch(token))), _hash("ip", bool(PATTERNS["ip"].fullmatch(token)) and _good("ip", token)), _hash("luhn", 12 <= len(digits) <= 19 and luhn(digits))]
    return soft, hard


class Graph:
    """Nodes and edges of a batch of documents."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.soft: list[list[int]] = []
        self.hard: list[list[int]] = []
        self.labels: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        last: dict[str, int] = {}
        previous = None
        at = 0
        for i, (start, end) in enumerate(tokens):
            token = text[start:end]
            if not ("@" in token or DIGITS.search(token)):
                continue
            node = len(self.spans)
            left = text[slice(*tokens[i - 1])] if i else ""
            right = text[slice(*tokens[i + 1])] if i + 1 < len(tokens) else ""
            soft, hard = _node(text, start, end, left, right)
            while at < len(base) and base[at][2] <= start:
                at += 1
            label = next((k + 1 for s, k, e in base[at : at + 4] if s < end and e > start), 0)
            self.spans.append((doc, start, end))
            self.soft.append(soft)
            self.hard.append(hard)
            self.labels.append(label)
            if previous is not None and i - previous[0] <= 2:
                self.chain.append((previous[1], node))
            previous = (i, node)
            key = key_of(token)
            if key:
                if key in last:
                    self.skip.append((last[key], node))
                last[key] = node


class Crf:
    """Node weights (features x labels), chain and skip log potentials."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def potentials(self, g: Graph) -> np.ndarray:
        flat = np.array([s + h for s, h in zip(g.soft, g.hard)], np.int64)
        return self.weights[flat].sum(axis=1)

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Sum-product messages along both directions of every edge, damped, for ``rounds`` rounds."""
        theta = self.potentials(g)
        n, k = theta.shape
        edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
        if len(edges):
            psi = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            m = np.zeros((len(src), k))
            for _ in range(rounds):
                into = theta.copy()
                np.add.at(into, dst, m)
                out = into[src] - m[back]
                new = _lse(out[:, :, None] + psi, 1)
                m = 0.5 * m + 0.5 * (new - _lse(new, 1)[:, None])
            theta = theta.copy()
            np.add.at(theta, dst, m)
        return np.exp(theta - _lse(theta, 1)[:, None])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit(texts: list[str], steps: int = 300, rate: float = 0.5, seed: int = 3) -> Crf:
    """Piecewise training on base labels; texts without nodes give a model that labels nothing."""
    g = Graph()
    for i, t in enumerate(texts):
        g.add(i, t, base_spans(t))
    k = len(KINDS) + 1
    weights = np.zeros((FEATURES, k))
    weights[_hash("bias"), 0] = 2.0
    chain, skip = np.ones((k, k)), np.full((k, k), 0.05)
    if g.spans:
        rng = np.random.default_rng(seed)
        y = np.array(g.labels)
        # an unmatched mention of what is matched elsewhere is unlabelled, not clean
        unsure = {n for a, b in g.skip for n, m in ((a, b), (b, a)) if not y[n] and y[m]}
        sure = np.array([n for n in range(len(y)) if n not in unsure])
        soft, hard = np.array(g.soft), np.array(g.hard)
        gone = _hash("gone")
        onehot = np.eye(k)[y]
        grads = np.zeros_like(weights)
        for _ in range(steps):
            pick = rng.choice(sure, 512)
            drop = rng.random((len(pick), 1)) < 0.3
            x = np.concatenate([soft[pick], np.where(drop, gone, hard[pick])], axis=1)
            s = weights[x].sum(axis=1)
            p = np.exp(s - _lse(s, 1)[:, None])
            d = np.zeros_like(weights)
            np.add.at(d, x.ravel(), np.repeat(onehot[pick] - p, x.shape[1], axis=0) / len(pick))
            d -= 1e-5 * weights
            grads += d * d
            weights += rate * d / np.sqrt(grads + 1e-6)
        for table, edges in ((chain, g.chain), (skip, g.skip)):
            for a, b in edges:
                if a in unsure or b in unsure:
                    continue
                table[y[a], y[b]] += 1
                table[y[b], y[a]] += 1
    # repeated mentions agree: prior counts before any are seen
    skip += np.diag(np.full(k, 20.0))
    both = [t / t.sum() for t in (chain, skip)]
    logs = [np.log(t) - np.log(t.sum(axis=1))[:, None] - np.log(t.sum(axis=0))[None] for t in both]
    return Crf(weights, logs[0] * 0.5, logs[1])


def added_spans(crf: Crf, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the CRF finds beside the base spans: runs of one label that touch no base span."""
    g = Graph()
    for i, t in enumerate(texts):
        g.add(i, t, bases[i])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not g.spans:
        return out
    best = crf.marginals(g)
    soft = best.argmax(axis=1)
    label = np.where(best.max(axis=1) >= LEAST, soft, 0)
    linked = set(g.chain)
    node = 0
    while node < len(label):
        if not label[node] or g.labels[node]:
            node += 1
            continue
        end = node
        # a sure token begins a span, likely ones go on with it
        while end + 1 < len(label) and soft[end + 1] == label[node] and not g.labels[end + 1] and (end, end + 1) in linked:
            end += 1
        doc, start, stop = g.spans[node][0], g.spans[node][1], g.spans[end][2]
        start, stop = trimmed(texts[doc], start, stop)
        if stop > start:
            out[doc].append((start, int(label[node]) - 1, stop))
        node = end + 1
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAINING_DOCS) -> Crf:
    """Fit on at most ``limit`` documents of at most TRAINING_CHARS that hold a digit or an @, the first by hash of the id."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")).filter((F.length("text") <= TRAINING_CHARS) & F.col("text").rlike("[0-9@]"))
    ids = staged(rows.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(limit), "pii-sample")
    texts = rows.join(F.broadcast(ids), "_id", "left_semi").select("_id", "text").collect()  # at most limit texts, unless ids repeat
    return fit([r["text"] for r in sorted(texts, key=lambda r: (str(r["_id"]), r["text"]))[:limit]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Offsets count code points, ends exclusive. Null counts as empty, without
    spans; repeated rows get a row each; an empty table gives no rows; columns
    not named aren't read.
    """
    crf = crf or train(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = byte_texts(batch.column(1))
            n = len(raw)
            counts = np.zeros((len(KINDS), n), np.int64)
            shas, spans, added = [nothing] * n, [""] * n, np.zeros(n, np.int64)
            for at in range(0, n, 2000):
                which = [i for i in range(at, min(at + 2000, n)) if SPARSE.search(raw[i])]
                texts = [raw[i].decode() for i in which]
                bases = [base_spans(t) for t in texts]
                for i, base, more in zip(which, bases, added_spans(shared.value, texts, bases)):
                    for _, k, _ in base:
                        counts[k, i] += 1
                    shas[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i], added[i] = joined(base + more), len(more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(shas), pa.array(spans), pa.array(added)], [id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col], docs[text_col])
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
