"""Exact dedup, near-dedup and line dedup against brute force, with awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import dart, exact, linechunks, queries

SCHEMA = "doc_id long, text string, lang string, source string, _id string, _loc string, kept string, n string, cls string, token string, size string"


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", s, "x", "x", "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, "a b c", "s"), (2, "a b c", "s"), (2, "a b c", "s"), (3, None, None), (4, "", "s"), (5, "a b c ", "s"), (None, "a b c", "s"), (6, LONG, "t"), (7, LONG, "t"), (8, "é" * 10, "t")]


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.length(c)])
@pytest.mark.parametrize("per_batch", [1, 4096])
def test_exact(spark, digest, per_batch):
    out = exact.exact_dedup(table(spark, ROWS).repartition(3), digest=digest, files_per_batch=per_batch).collect()
    assert len(out) == len(ROWS)
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_empty_and_stage(spark):
    assert exact.exact_dedup(table(spark, [])).count() == 0
    out = exact.drop_copies(table(spark, ROWS))
    assert out.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t, _ in ROWS})


def bag(text):
    """Five-word shingles with their numbers of occurrences, by plain Python."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, threshold=0.8, weighted=True):
    sets = [bag(t) if weighted else Counter(set(bag(t))) for _, t, _ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] & sets[j]).total() / (sets[i] | sets[j]).total() >= threshold:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return Counter(tuple(sorted(x for x in g)) for g in groups.values())


def near_rows(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(12):
        base = [f"t{x}" for x in rng.integers(0, 400, rng.integers(3, 200))]
        for _ in range(rng.integers(1, 7)):
            w = list(base)
            for _ in range(int(rng.integers(0, max(1, len(w) // 25 + 1)))):
                w[rng.integers(len(w))] = f"u{rng.integers(1000)}"
            rows.append((k, " ".join(w), "s"))
            k += 1
    return rows + [(k, None, "s"), (k + 1, "", "s"), (k + 2, "!!", "s"), (k + 3, "one", "s"), (k + 4, "One.", "s")]


@pytest.mark.parametrize("seed, weigh", [(1, dart.occurrences), (2, None)])
def test_near_duplicates_against_brute_force(spark, seed, weigh):
    rows = near_rows(seed) + [(500 + k, "again and again we say the same " * (10 + k), "s") for k in range(6)]
    out = dart.near_duplicates(table(spark, rows), weigh=weigh).collect()
    got = defaultdict(list)
    for r in out:
        got[r.class_id].append(r.doc_id)
    assert Counter(tuple(sorted(g)) for g in got.values()) == brute(rows, weighted=weigh is not None)
    assert sum(r.kept for r in out) == len(got) and all(r.class_size == len(got[r.class_id]) for r in out)


def test_near_duplicates_chains_keep_links(spark):
    """A chain whose ends are unlike: leaders alone would miss links."""
    words = [f"w{i}" for i in range(240)]
    rows = [(k, " ".join(words[k * 8 : k * 8 + 150]), "s") for k in range(10)]
    out = dart.near_duplicates(table(spark, rows))
    assert out.select("class_id").distinct().count() == sum(1 for _ in brute(rows))


def test_near_duplicates_edges(spark):
    assert dart.near_duplicates(table(spark, [])).count() == 0
    out = dart.near_duplicates(table(spark, [(1, LONG, "s"), (1, LONG, "s"), (None, LONG + " tail", "s")])).collect()
    assert len({r.class_id for r in out}) == 1 and sum(r.kept for r in out) == 1
    left = dart.drop_near_duplicates(table(spark, near_rows(3)))
    assert left.columns == table(spark, []).columns and left.count() == sum(brute(near_rows(3)).values())
    few = table(spark, [(1, "a b c d e f " * 9, "s"), (2, "a b c d e f " * 3, "s")])
    assert dart.near_duplicates(few).select("class_id").distinct().count() == 2
    assert dart.near_duplicates(few, weigh=lambda x, n: n ** 0.1).select("class_id").distinct().count() == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for s in (0.5, 0.8):
        est = []
        for _ in range(60):
            m = 300
            both = int(2 * m * s / (1 + s))
            pool = rng.integers(0, 2**63, 2 * m).astype(np.uint64)
            a, b = np.unique(pool[:m]), np.unique(np.concatenate([pool[:both], pool[m : 2 * m - both]]))
            sig = dart.dart_signatures(np.concatenate([a, b]), None, np.array([len(a), len(b)]), 120)
            est.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(est) - s) < 0.02
    x = np.array([5, 9], np.uint64)
    two = dart.dart_signatures(np.concatenate([x, x]), np.array([1, 3, 3, 1]), np.array([2, 2]), 400)
    assert abs((two[0] == two[1]).mean() - 2 / 6) < 0.1  # weighted: min 1 + 1 of max 3 + 3
    for _ in range(4):  # real weights, small and large
        m = 80
        x = rng.integers(0, 2**63, m).astype(np.uint64)
        a, b = np.exp(rng.normal(0, 2, m)), np.exp(rng.normal(0, 2, m))
        sig = dart.dart_signatures(np.concatenate([x, x]), np.concatenate([a, b]), np.array([m, m]), 2000)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    heavy = dart.dart_signatures(np.concatenate([x[:3], x[:3]]), np.array([1e6, 2.0, 3e5, 2e6, 0.5, 3e5]), np.array([3, 3]), 2000)
    assert abs((heavy[0] == heavy[1]).mean() - 1.3 / 2.3) < 0.05


def brute_lines(rows, key=None):
    found, gone = defaultdict(list), defaultdict(set)
    for at, (i, t, _) in enumerate(rows):
        lines = (t or "").encode().split(b"\n")
        for k, (s, n) in enumerate(linechunks.chunk_lines(lines)):
            if n > 1:
                found[b"\n".join(lines[s : s + n])].append((i, at, k, s, n))
    for v in found.values():
        for i, at, k, s, n in sorted(v)[1:]:
            gone[at] |= set(range(s, s + n))
    return Counter((i, "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone[at])) for at, (i, t, _) in enumerate(rows))


@pytest.mark.parametrize("key", [linechunks.key_of, lambda b: bytes([len(b) % 3])])
def test_line_chunks(spark, key):
    rng = np.random.default_rng(4)
    passage = "\n".join(f"shared line {i} of the passage with several words" for i in range(12))
    rows = []
    for k in range(25):
        own = [f"own {k} {rng.integers(10**6)}" for _ in range(rng.integers(0, 9))]
        cut = int(rng.integers(0, len(own) + 1))
        rows.append((k, "\n".join([*own[:cut], *([passage] if k % 2 else []), *own[cut:]]), "s"))
    rows += [(90, None, "s"), (91, "", "s"), (92, "x\n" * 300, "s"), (93, LONG + "\n" + LONG, "s"), (94, "\n\n\n", "s")]
    out = linechunks.dedup_lines(table(spark, rows), key=key).collect()
    assert Counter((r.doc_id, r.text) for r in out) == brute_lines(rows)
    # most of the passage goes from all but the first document
    assert np.mean([r.n_removed for r in out if r.doc_id < 25 and r.doc_id % 2 and r.doc_id > 1]) > 6
    assert linechunks.dedup_lines(table(spark, [])).count() == 0
    again = linechunks.dedup_lines(table(spark, [(1, "a\nb\nc\nd", "s")] * 2)).collect()
    assert sorted(r.n_removed for r in again)[0] == 0


def brute_windows(rows):
    """Lines left of each row if every repeated pair of lines or long line goes from all but its first place."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    first, gone = {}, defaultdict(set)
    for at in order:
        lines = (rows[at][1] or "").split("\n")
        for s in range(len(lines)):
            for n in (1, 2):
                unit = tuple(lines[s : s + n])
                if len(unit) < n or n == 1 and len(unit[0].split()) <= 50:
                    continue
                doc, start = first.setdefault(unit, (at, s))
                if (doc, start) != (at, s):
                    gone[at] |= set(range(s, s + n)) - (set(range(start, start + n)) if doc == at else set())
    return Counter((i, "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone[at])) for at, (i, t, _) in enumerate(rows))


@pytest.mark.parametrize("key", [linechunks.key_of, lambda b: bytes([len(b) % 3])])
def test_line_windows(spark, key):
    rng = np.random.default_rng(6)
    rows = [(k, "\n".join(f"line {x}" + " word" * (60 * (x % 5 == 0)) for x in rng.integers(0, 40, rng.integers(0, 12))), "s") for k in range(40)]
    rows += [(90, None, "s"), (91, "", "s"), (92, "x\n" * 300, "s"), (93, LONG + "\n" + LONG, "s"), (94, "\n\n\n", "s"), (None, rows[5][1], "s")]
    out = linechunks.dedup_lines(table(spark, rows), key=key, units=linechunks.window_lines).collect()
    assert Counter((r.doc_id, r.text) for r in out) == brute_windows(rows)
    for r in out:
        spans = [tuple(map(int, x.split(":"))) for x in r.removed.split(",") if x]
        assert sum(n for _, n in spans) == r.n_removed and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_query_removes_whole_passages(spark, tmp_path):
    """Passages of 2 to 12 lines, and long lines alone, in surroundings of their own: nothing of the second copy is left."""
    rows, want = [], {}
    for p in range(60):
        size = p % 12 + 1
        passage = [f"passage {p} line {x}" + " word" * (60 * (size == 1)) for x in range(size)]
        for copy in range(2):
            own = [f"own {p} {copy} {x}" for x in range(7)]
            rows.append((2 * p + copy, "\n".join([*own[: p % 8], *passage, *own[p % 8 :]]), "s"))
            want[2 * p + copy] = "\n".join(own) if copy else rows[-1][1]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in queries.op10_line_chunks(spark, str(tmp_path)).collect()} == want


def test_chunk_boundaries_resist_shifts():
    lines = [f"line {i}".encode() for i in range(200)]
    a = {tuple(lines[s : s + n]) for s, n in linechunks.chunk_lines(lines)}
    b = {tuple(([b"new"] + lines)[s : s + n]) for s, n in linechunks.chunk_lines([b"new"] + lines)}
    assert len(a & b) > 0.9 * len(a)
    assert sum(n for _, n in linechunks.chunk_lines(lines)) == 200
