"""PII, LM scoring, quality, decontamination, mixing, WARC and HTML, with awkward rows."""

import gc
import hashlib
import html
import io
import json
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadrille.llm import decontam, htmltext, kneser, lbl, mixing, pii, warc

SCHEMA = "doc_id long, text string, lang string, source string, _id string, w string, words string, item string, size string, n_hit string, c string, copy string"
LONG = " ".join(f"w{i % 5000}" for i in range(40_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, *"xxxxxxxx") for i, t, lang, s in rows], SCHEMA)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if pii._good(kind, m[0]))


def test_base_patterns_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(5000):
        t = "".join(rng.choice(list("a1 2.@_+-(3)b.%4\n9é"), rng.integers(0, 40)))
        assert pii.base_spans(t) == base(t), t
    assert pii.base_spans("1" * 200_000 + "." + "x" * 200_000 + "@") == []


def test_pii(spark):
    mail = "écrit à bob.smith@example.com, +1 (799) 555-3729 et 64.147.79.24"
    rows = [(1, mail, "fr", "s"), (1, mail, "fr", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, "card 4111 1111 1111 1111 then 4111-1111-1111-1112", "en", "s"), (None, "no data here", "en", "s"), (5, LONG + " a@b.co", "en", "s")]
    rows += [(100 + k, f"mail user{k}@host{k}.org from 10.0.{k}.1 or +44 20 7946 0{k:03d}", "en", "s") for k in range(60)]
    rows += [(200, "write bob.smith@example.com first " + "filler " * 3000 + "then bob.smith@example too", "en", "s")]
    out = pii.find(table(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t, *_ in rows:
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t or ""))
        assert by[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(by[i].spans.split(","))
    assert (by[1].n_email, by[1].n_ip, by[1].n_phone, by[4].n_card) == (1, 1, 1, 1)
    assert by[200].n_added == 1  # the distant repetition is labelled like the clear mention
    assert by[None].spans == "" and by[5].n_email == 1
    assert pii.find(table(spark, [])).count() == 0


def test_crf_messages_match_enumeration():
    """On a tree, belief propagation is exact."""
    rng = np.random.default_rng(2)
    k = len(pii.KINDS) + 1
    crf = pii.Crf(rng.normal(size=(pii.FEATURES, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    g = pii.Graph()
    g.spans, g.soft, g.hard = [(0, i, i) for i in range(3)], [[1], [2], [3]], [[4], [5], [6]]
    g.chain, g.skip = [(0, 1)], [(1, 2)]
    theta = crf.potentials(g)
    p = np.exp(theta[0][:, None, None] + theta[1][None, :, None] + theta[2][None, None] + crf.chain[:, :, None] + crf.skip[None])
    p /= p.sum()
    got = crf.marginals(g, rounds=60)
    for i, axes in enumerate([(1, 2), (0, 2), (0, 1)]):
        assert np.allclose(got[i], p.sum(axis=axes), atol=1e-5)


def sentences(n, seed=0):
    rng = np.random.default_rng(seed)
    nxt = {w: rng.choice(60, 4) for w in range(60)}
    rows = []
    for i in range(n):
        w, out = int(rng.integers(60)), []
        for _ in range(int(rng.integers(5, 60))):
            out.append(f"Word{w}" if rng.random() < 0.9 else f"rare{rng.integers(3000)}")
            w = int(rng.choice(nxt[w]))
        rows.append((i, " ".join(out), "en", "s"))
    return rows


@pytest.mark.parametrize("head", [5, 300_000])
def test_lm_scores(spark, head):
    rows = sentences(400) + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "a b\x0bc \t d", "en", "s"), (1003, LONG, "en", "s"), (5, sentences(400)[5][1], "en", "s")]
    out = lbl.score(table(spark, rows), head=head).collect()
    assert len(out) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    seen = Counter(w for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    text = {i: t for i, t, *_ in rows}
    for r in out:
        ws = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(seen[w] > 0 for w in ws), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)  # less negative than the base


def test_lm_is_normalised(spark):
    model = lbl.Lbl(6, np.full(6, 1 / 6))
    z = model.normalisers().reshape(7, 7)
    for a in range(7):
        for b in range(7):
            s = (model.left[a] + model.near[b]) @ model.out.T + model.bias
            assert math.isclose(np.exp(s - z[a, b]).sum(), 1, rel_tol=1e-4)
    assert lbl.score(table(spark, [])).count() == 0
    alone = lbl.score(table(spark, [(i, "x y", "en", "s") for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0])).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)


def test_quality(spark):
    good = sentences(300, 1)
    bad = [(1000 + k, " ".join(f"@@{x}##" for x in np.random.default_rng(k).integers(0, 10**6, 40)), "en", "s") for k in range(30)]
    odd = [(2000, None, "en", "s"), (2001, "", None, "s"), (2002, "word", "xx", "s"), (2003, LONG, "en", "s"), (3, good[3][1], "en", "s")]
    docs = table(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good[:200]] + [(i, 0, 0) for i, *_ in bad[:5]], "doc_id long, quality int, toxic int")
    out = kneser.quality(docs, labels, trusted_docs=100).collect()
    assert len(out) == 335
    assert not any(r.kept for r in out if 1000 <= r.doc_id < 1030)
    assert np.mean([r.kept for r in out if r.doc_id < 300]) > 0.97
    assert all(r.kept for r in out if r.doc_id in (2000, 2001))
    left = kneser.drop_low_quality(docs, labels, trusted_docs=100)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in out)
    none = labels.limit(0)
    assert kneser.quality(docs, none).filter("kept").count() == 335
    assert kneser.quality(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("trusted_docs", [180, 4_000])
def test_quality_thresholds_are_of_unseen_documents(spark, trusted_docs):
    """Whether the trusted documents fit the sample or not, clean documents that training hasn't seen are kept like them."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 50_000) for _ in range(600)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(1000 + i, texts[i], "en", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(200), *range(1000, 1040)]], "doc_id long, quality int, toxic int")
    sample = {r[0] for r in kneser.trusted_sample(labels, trusted_docs).collect()}
    held = [i for i in [*range(200), *range(1000, 1040)] if not sample & {i, i % 1000, i + 1000}]
    assert len(held) > 10
    out = {r.doc_id: r for r in kneser.quality(table(spark, rows), labels, trusted_docs=trusted_docs).collect()}
    threshold = out[0].threshold
    assert math.isclose(threshold, max(out[i].cost for i in held))
    assert np.mean([out[i].kept for i in range(200, 600)]) > 0.9


def test_stages_drop_rows_not_ids(spark):
    """A bad row takes no clean row of the same or no id with it; bad copies all go."""
    good = sentences(300, 1)
    clean = [(None, good[250][1], "en", "s"), (None, good[251][1], "en", "s"), (7000, good[252][1], "en", "s")]
    junk = " ".join(f"@@{x}##" for x in range(40))
    docs = table(spark, good + clean + [(i, junk, "en", "s") for i in (None, None, 7000)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    left = [(r.doc_id, r.text) for r in kneser.drop_low_quality(docs, labels, quantile=1.0, trusted_docs=100).collect()]
    assert junk not in [t for _, t in left]
    assert Counter(left) >= Counter((i, t) for i, t, *_ in clean)
    leak = " ".join(f"leak{x}" for x in range(30))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = clean + [(i, leak, "en", "s") for i in (None, None, 7000)] + [(None, None, "en", "s")]
    left = decontam.drop_contaminated(table(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter((i, t) for i, t, *_ in [*clean, rows[-1]])


def test_kneser_ney_sums_to_one(spark):
    docs = table(spark, sentences(60, 2))
    model = kneser.train(docs)
    every = np.arange(model.size)
    for a, b in [(1, 1), (1, 4), (5, 6), (0, 9), (30, 31)]:
        logs = model.score((a * model.size + b) * model.size + every)
        assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-6)


def kneser_brute(texts):
    """Interpolated modified Kneser-Ney with dictionaries: log probability of a list of words."""
    grams = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.encode().split(), "</s>"]
        grams.update(zip(w, w[1:], w[2:]))
    two = Counter(g[1:] for g in grams)
    one = Counter(g[1] for g in two)
    size = len({x for t in texts for x in t.encode().split()}) + 3

    def cut(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d)]
        return {g: c - d[min(c, 3) - 1] for g, c in counts.items()}

    c1, c2, c3 = cut(one), cut(two), cut(grams)
    h2, h3 = Counter(), Counter()
    for g, c in two.items():
        h2[g[:1]] += c
    for g, c in grams.items():
        h3[g[:2]] += c
    l2, l3 = Counter(h2), Counter(h3)
    for g, c in c2.items():
        l2[g[:1]] -= c
    for g, c in c3.items():
        l3[g[:2]] -= c
    total = sum(one.values())
    spare = (total - sum(c1.values())) / total / size

    def p(a, b, c):
        low = c1.get(c, 0) / total + spare
        low = c2.get((b, c), 0) / h2[b,] + l2[b,] / h2[b,] * low if (b,) in h2 else low
        return c3.get((a, b, c), 0) / h3[a, b] + l3[a, b] / h3[a, b] * low if (a, b) in h3 else low

    known = {x for t in texts for x in t.encode().split()}

    def score(t):
        w = ["<s>", "<s>", *(x if x in known else None for x in t.encode().split()), "</s>"]
        return sum(math.log(p(*g)) for g in zip(w, w[1:], w[2:]))

    return score


def test_kneser_ney_against_dictionaries(spark):
    rows = sentences(80, 3)
    score = kneser_brute([t for _, t, *_ in rows[:50]])
    docs = table(spark, [*rows, (900, None, "en", "s"), (901, "Word1  word?\x0bWord2 \u00a0x", "en", "s")])
    model = kneser.train(table(spark, rows[:50]))
    got = {r.doc_id: r.log_prob for r in kneser.perplexities(kneser.filed(docs), model).collect()}
    for i, t, *_ in [*rows, (900, "", 0), (901, "Word1  word?\x0bWord2 \u00a0x", 0)]:
        assert math.isclose(got[i], score(t), rel_tol=1e-9)


@pytest.mark.parametrize("shard_bytes", [16 << 20, 20_000])
def test_quality_learns_from_all_trusted_documents(spark, monkeypatch, shard_bytes):
    """More than 4,000 trusted documents, in one shard and in many with frequent words spread over several: scores are those of all but the reserve."""
    monkeypatch.setattr(kneser.ngrams, "SHARD_BYTES", shard_bytes)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 16)) % 3_000) for _ in range(6_500)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(9000, None, "en", "s"), (9001, "new w1 w1 \u00a0x\x0bw2", None, "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6_000)], "doc_id long, quality int, toxic int")
    kept_out = {r[0] for r in labels.filter(kneser.reserved("doc_id")).select("doc_id").collect()}
    made = []
    layout_of = kneser.ngrams.layout_of
    monkeypatch.setattr(kneser.ngrams, "layout_of", lambda *x: made.append(layout_of(*x)) or made[0])
    score = kneser_brute([texts[i] for i in range(6_000) if i not in kept_out])
    out = {r.doc_id: r for r in kneser.quality(table(spark, rows), labels).collect()}
    assert len(out) == len(rows) and 6_000 - len(kept_out) > 4_000
    assert (len(made[0][0].hot) > 1 and made[0][0].shards > 4) == (shard_bytes < 1 << 20)
    for i, t, *_ in rows:
        assert out[i].n_tokens == len((t or "").encode().split()) + 1
        assert math.isclose(out[i].log_prob, score(t or ""), rel_tol=1e-8)
    trained = {texts[i] for i in range(6_000) if i not in kept_out}
    costs = sorted(out[i].cost for i in kept_out if texts[i] not in trained)
    assert costs[math.ceil(0.995 * len(costs)) - 1] == out[0].threshold


def test_words_of_texts_go_with_them():
    """Workers pack text after text: the words of one must not stay, not even until Python collects its garbage."""
    texts = [" ".join(f"w{i * 100 + k}" for k in range(100)).encode() for i in range(300)]
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        hashes, ids, counts = kneser.ngrams._words(texts)
        assert len(hashes) == 30_002 and len(ids) == counts.sum() == 30_300
        del hashes, ids, counts
        assert tracemalloc.get_traced_memory()[0] < 100_000
    finally:
        tracemalloc.stop()
        gc.enable()


def test_batches_end_by_bytes(spark, monkeypatch, tmp_path):
    """Batches of long texts end by their bytes, also where all rows are fewer than a batch may have; scores are the same."""
    rows = spark.range(0, 300, 1, 1).selectExpr("id AS key", "array_join(transform(sequence(1, 200), k -> 'w' || (id * k) % 997), ' ') AS text")
    seen = tmp_path / "seen"

    def spying(run):
        def task(batches):
            def told():
                for batch in batches:
                    with open(seen, "a") as f:
                        print(batch.nbytes, file=f)
                    yield batch

            yield from run(told())

        return task

    def scores():
        return sorted(map(tuple, kneser.ngrams.scores(kneser.staged(rows, "rows"), np.arange(0, 300, 2), kneser._cuts).collect()))

    before = scores()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(name)
    monkeypatch.setattr(kneser.ngrams, "returning", spying)
    monkeypatch.setattr(kneser.ngrams, "BLOCK_BYTES", 64 << 10)
    assert scores() == before and len(before) == 300
    sizes = [int(x) for x in seen.read_text().split()]
    assert max(sizes) <= 128 << 10 and sum(sizes) > 600_000  # a block's bytes, and the row that passes them
    assert spark.conf.get(name) == limit


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


@pytest.mark.parametrize("bound, piece", [(100_000, 500_000), (0, 500_000), (0, 20)])
def test_decontamination(spark, bound, piece):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(80)] + ["the", "of", "é"]
    item = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, item(n)) for k, n in enumerate([40, 13, 14, 5, 1, 30, 60])] + [(90, None), (91, "..."), (0, "The the THE the the the the the the the the the the the")]
    rows = []
    for k in range(60):
        parts = [item(int(rng.integers(0, 120)))]
        if k % 3 == 0:
            w = words(items[int(rng.integers(7))][1])
            s = int(rng.integers(0, max(1, len(w) - 13)))
            parts.append(", ".join(w[s : s + int(rng.integers(8, 40))]).upper())
            parts.append(item(int(rng.integers(0, 60))))
        rows.append((k, " ".join(parts), "en", "s"))
    rows += [(70, None, "en", "s"), (71, "", "en", "s"), (72, "the " * 400, "en", "s"), (0, rows[0][1], "en", "s"), (None, items[0][1], "en", "s"), (73, LONG, "en", "s")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    out = decontam.decontaminate(table(spark, rows), bench, broadcast_windows=bound, piece_tokens=piece).collect()
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12)):
            if w:
                windows[tuple(w[s : s + 13])].add(str(i))
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        hit, its = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    its |= windows[tuple(w[s : s + n])]
        want[(i, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert Counter(tuple(r) for r in out) == want
    left = decontam.drop_contaminated(table(spark, rows), bench)
    assert left.columns == table(spark, []).columns
    full = {x for x in windows if len(x) == 13}
    stay = Counter()
    for i, t, *_ in rows:
        w = words(t)
        hit = {p for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
        if not any(tuple(w[s : s + 13]) in full for s in range(len(w) - 12)) and not (hit and 20 * len(hit) >= len(w)):
            stay[i, t] += 1
    assert Counter((r.doc_id, r.text) for r in left.collect()) == stay
    assert decontam.decontaminate(table(spark, []), bench).count() == 0
    assert not decontam.decontaminate(table(spark, rows), bench.limit(0)).filter("contaminated").count()


def test_decontamination_finds_passages_in_long_documents(spark):
    """One window in 30,000 words is no 5 %, but a passage; a short item that many texts hold is none."""
    item = " ".join(f"q{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item), (2, "and so on")], "item_id long, text string")
    rows = [(k, f"{LONG} {' '.join(item.split()[3:16])} {LONG}", "en", "s") for k in range(2)] + [(5, f"{LONG} and so on", "en", "s"), (6, LONG, "en", "s"), (7, " ".join(item.split()[:12]), "en", "s")]
    out = {r.doc_id: (r.n_hit, r.contaminated) for r in decontam.decontaminate(table(spark, rows), bench).collect()}
    assert out == {0: (13, False), 1: (13, False), 5: (3, False), 6: (0, False), 7: (0, False)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(table(spark, rows), bench).collect()) == [5, 6, 7]


def waterfill(sizes, share=1.5, cap=2.0, cycle=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    target, todo, left = {}, list(names), share * sum(sizes.values())
    while todo:
        level = left / sum(weight[s] for s in todo)
        over = [s for s in todo if weight[s] * level > cap * sizes[s]]
        for s in over or todo:
            target[s] = cap * sizes[s] if over else weight[s] * level
            left -= target[s]
        todo = [s for s in todo if s not in target]
    return target


def test_mixing(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "w " * int(rng.integers(1, 200)), "en", str(rng.choice(["a", "b", "c", "é", "Z"], p=[0.6, 0.1, 0.1, 0.1, 0.1]))) for k in range(3000)]
    rows += [(9000, "x y z", "en", None), (9001, None, "en", "a"), (9002, "", "en", "empty"), (9003, LONG, "en", "b"), (7, rows[7][1], "en", rows[7][3]), (None, "q", "en", "a")]
    docs = table(spark, rows)
    out = mixing.systematic_mix(docs, rows_per_salt=500).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(out) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for i, t, _, s in rows:
        assert s in sizes
    want = waterfill(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        biggest = max(r.size for r in out if r.source == s)
        assert abs(taken[s] - target[s]) <= max(biggest, 0.02 * target[s])
    again = mixing.systematic_mix(docs.repartition(5), rows_per_salt=500).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert Counter(out) == Counter(again)
    emitted = mixing.emit_copies(docs, rows_per_salt=500)
    assert emitted.columns == [*docs.columns, "copy_2"]
    assert mixing.emit_copies(docs.drop("copy"), rows_per_salt=500).columns == [*docs.columns[:-1], "copy"]
    # the number of salts changes nothing
    one = mixing.systematic_mix(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert Counter(out) == Counter(one)
    # the same draw, document by document
    place = defaultdict(list)
    for k, (i, t, _, src) in enumerate(rows):
        size, name = len((t or "").split()), "" if i is None else str(i)
        place[src].append((math.isqrt(size), int(hashlib.md5(f"mix/{name}".encode()).hexdigest()[:8], 16), size, name, i))
    want = Counter()
    for src, held in place.items():
        u = int(hashlib.md5(f"mix/offset/{int(src is None)}/{src or ''}".encode()).hexdigest()[:8], 16) / 2**32
        step = target[src] / sizes[src] if sizes[src] else 0.0
        for n, (_, _, size, _, i) in enumerate(sorted(held, key=lambda x: x[:4]), 1):
            want[i, src, min(math.floor(u + n * step) - math.floor(u + (n - 1) * step), 2)] += 1
    assert Counter((r.doc_id, r.source, r.copies) for r in out) == want
    assert emitted.count() == sum(r.copies for r in out)
    assert mixing.systematic_mix(table(spark, [])).count() == 0


def test_warc(spark):
    big = "<p>é" + "x" * 200
    rows = [(3, "http://a/3\r\nX: y", big), (1, "http://a/1", big), (2, None, big), (2, "http://a/2", big), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (9, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", LONG * 20), (None, "u", "z" * 150)]
    pages = spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], "page_id long, url string, html string, payload_digest string, original string, _loc string")
    out = warc.archive_round_trip(pages.repartition(3)).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 10**9), 10**9 if i is None else i)
    assert len(out) == len(rows)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first[h] != (10**9 if i is None else i)
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None)] += 1
    assert got == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    twice = warc.archive_round_trip(spark.createDataFrame([(1, "u", big)] * 3, "page_id long, url string, html string")).collect()
    assert Counter(r.record_type for r in twice) == {"response": 1, "revisit": 2}


def test_warc_payloads_survive(spark, tmp_path):
    rows = [(k, f"u{k}", f"<p>{k}\r\n\r\n" + "é" * k) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    records = warc.read_archives(spark, warc.write_archives(pages, folder), folder, payloads=True).collect()
    assert {int(r.page): bytes(r.payload).decode() for r in records} == {i: h for i, _, h in rows}
    assert all(r.digest == r.declared for r in records)
    whole = next((tmp_path / "w").glob("*.gz")).read_bytes()
    assert len(list(warc.members(io.BytesIO(whole)))) > 0
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(whole + whole[:50])))


@pytest.fixture(scope="module")
def labeller():
    return htmltext.trained(pages=500)


def test_labeller_on_held_out_pages(labeller):
    rng, f = np.random.default_rng(77), htmltext.Features()
    right = total = 0
    for _ in range(150):
        page, want = htmltext.synthetic_page(rng)
        found = htmltext.blocks(page)
        assert len(found) == len(want)
        if found:
            got = labeller.main_blocks([[f.of(b) for b in found]])[0]
            right += int((got == np.array(want, bool)).sum())
            total += len(want)
    assert right / total > 0.98


def test_blocks():
    page = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><!-- <p>no</p> --><p>a &amp; b&nbsp;<b>c</b>\n d<br>e<p>f<ul><li>g<li>h &lt;x&gt; &copy</ul><form><textarea>no</textarea>i</form><table><tr><td>j<td>k</table>tail'
    assert [t for _, t in htmltext.blocks(page)] == ["a & b c d e", "f", "g", "h <x> ©", "i", "j", "k", "tail"]
    assert htmltext.blocks("") == [] and htmltext.blocks("plain") == [((), "plain")]
    assert htmltext.blocks("<p>a<!-- open")[0][1] == "a" and htmltext.blocks('<p class="a>b')[-1:] is not None


def test_extract(spark, labeller):
    para = "A sentence of the story, with several words in it."
    article = "".join(f"<p>{para} {k}</p>" for k in range(12))
    page = f'<html><head><title>no</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Head &amp; line</h1>{article}</article><footer>&copy; all rights reserved</footer></body></html>'
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<nav></nav>"), (5, "u", page.replace(article, article * 300))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = htmltext.extract(df, model=labeller).collect()
    assert len(out) == 6
    want = "\n".join(["Head & line", *[f"{para} {k}" for k in range(12)]])
    by = {r.page_id: r for r in out}
    assert by[1].text == want and by[1].n_chars == len(want)
    assert (by[2].text, by[3].text, by[4].text) == ("", "", "")
    assert by[5].text.count("\n") == 3600
    assert htmltext.extract(df.limit(0), model=labeller).count() == 0


def test_lstm_gradients():
    """Back-propagation against differences."""
    m = htmltext.Labeller(3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    pages = [[([1, 2], [3], [0.1, 1, 0, 0.2, 1.0])] * 3, [([4], [5, 6], [0.5, 0, 0.1, 0.3, 1.0])]]
    labels = [[1, 0, 1], [0]]

    def loss():
        z, _ = m.forward(pages)
        y = np.concatenate(labels)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    before = loss()
    m.train(pages, labels, epochs=60)
    assert loss() < 0.5 * before


def test_queries_are_registered():
    from quadrille.llm import queries

    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert html and json
