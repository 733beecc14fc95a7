"""The corpus pipeline, stage by stage and whole, against brute force on a small corpus with awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql.types import LongType

import corpus_pipeline
from quadrille.llm import common, dart
from tests.llm.test_dedup import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copy string"


def corpus():
    rng = np.random.default_rng(11)
    vocab = [f"word{x}" for x in range(300)]
    text = lambda n: " ".join(vocab[int(x)] for x in rng.zipf(1.4, n) % 300) + f" end{rng.integers(10**9)}"
    good = [text(int(rng.integers(30, 200))) for _ in range(260)]
    item = " ".join(f"bench{x}" for x in range(25))
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(good)]
    rows += [(300 + i, good[i], "en", "a") for i in range(10)]  # exact copies
    rows += [(320 + i, good[i + 20] + " tail", "en", "b") for i in range(10)]  # near copies
    rows += [(340, f"{text(900)} {' '.join(item.split()[2:17])} {text(900)}", "en", "a"), (341, " ".join(item.split()[:12]) + " " + text(900), "en", "a")]
    rows += [(None, good[40] + " of none", "en", "a"), (None, text(50), "en", None), (350, text(60), "en", "a"), (350, text(70), None, "b")]
    rows += [(360 + k, " ".join(f"@@{x}##" for x in rng.integers(0, 10**6, 60)), "en", "b") for k in range(8)]  # junk
    rows += [(380, None, "en", "a"), (381, "", "en", "a"), (382, "", None, None)]
    return rows, item


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), f"c{k}") for k, r in enumerate(rows)], COLUMNS)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def test_stages_and_run(spark, tmp_path):
    rows, item = corpus()
    sf = str(tmp_path)
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 260, 2)] + [(360, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, held = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns + ["copy_2"] * (k == 4)
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        held.append([tuple(r) for r in docs.collect()])
    start = [(*r, len(r[1] or ""), f"c{k}") for k, r in enumerate(rows)]
    # quality: junk goes, clean rows of any id stay; the threshold is the maximum of some 33 unseen costs, so one clean row in 34 is expected above it
    gone = Counter(start) - Counter(held[0])
    assert {360 + k for k in range(8)} <= {r[0] for r in gone.elements()} and sum(gone.values()) <= 8 + 20
    # exact: the largest id of each text stays
    best = defaultdict(list)
    for r in held[0]:
        best[r[1] or ""].append(r)
    assert sorted(r[1] or "" for r in held[1]) == sorted(best)
    assert all((r[0] or -1) == max(x[0] or -1 for x in best[r[1] or ""]) for r in held[1])
    # near: as many as there are classes
    assert len(held[2]) == sum(brute([(r[0] or -1, r[1], r[3]) for r in held[1]]).values())
    assert Counter(held[2]) <= Counter(held[1])
    # decontamination: any whole window, or a share of five percent
    w = words(item)
    full = {tuple(w[s : s + 13]) for s in range(len(w) - 12)}
    assert Counter(held[3]) == Counter(r for r in held[2] if not any(tuple(words(r[1])[s : s + 13]) in full for s in range(len(words(r[1])))))
    assert 340 in {r[0] for r in held[2]} and 340 not in {r[0] for r in held[3]} and 341 in {r[0] for r in held[3]}
    # mixing: prefix sums over each source
    place, want = defaultdict(list), Counter()
    for r in held[3]:
        n, name = len((r[1] or "").split()), "" if r[0] is None else str(r[0])
        place[r[3]].append((math.isqrt(n), hashlib.md5(f"mix/{name}".encode()).hexdigest()[:8], n, name, r))
    sizes = {s: sum(x[2] for x in v) for s, v in place.items()}
    from tests.llm.test_text import waterfill

    target = waterfill(sizes)
    for s, v in place.items():
        u, step = int(hashlib.md5(f"mix/offset/{int(s is None)}/{s or ''}".encode()).hexdigest()[:8], 16) / 2**32, target[s] / sizes[s] if sizes[s] else 0.0
        for n, x in enumerate(sorted(v, key=lambda x: x[:4]), 1):
            for copy in range(1, 1 + min(2, math.floor(u + n * step) - math.floor(u + (n - 1) * step))):
                want[(s, x[2], x[3], copy)] += 1
    assert Counter((r[3], len((r[1] or "").split()), "" if r[0] is None else str(r[0]), r[-1]) for r in held[4]) == want
    # the whole run gives the same rows
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == Counter(held[4])


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    frame(spark, []).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_tasks_give_memory_back(monkeypatch):
    """A worker outlives its tasks, so each gives freed memory back, also where its result isn't read to the end."""
    times = []
    monkeypatch.setattr(common, "give_back", lambda: times.append(1), raising=False)

    class Rows:
        schema = {"_id": SimpleNamespace(dataType=LongType())}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    run = dart.signatures(Rows(), 5, 4, 2, None)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", "b"]), pa.array(["some words here", None])], ["_id", "_loc", "_text"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 2 and len(times) == 1
    part = run(iter([batch]))
    next(part)
    part.close()
    assert len(times) == 2
