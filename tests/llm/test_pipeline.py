"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from nestfold.llm import packing, quality_rules
from nestfold.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def vote(rule, m):
    if m[rule.under] < rule.least:
        return 0
    x = m[rule.over] / max(m[rule.under], 1)
    if not rule.fair[0] <= x <= rule.fair[1]:
        return -1
    return int(rule.good[0] <= x <= rule.good[1])


def quality(rows):
    measured = [dict(zip((*quality_rules.BASE, *quality_rules.MORE), quality_rules.measures(r["text"]), strict=True)) for r in rows]
    votes = [tuple(vote(rule, m) for rule in quality_rules.RULES) for m in measured]
    model = quality_rules.fit(sorted(Counter(votes).items()), len(quality_rules.RULES))
    logit = [model.prior + sum(w[v + 1] for w, v in zip(model.weights, vs, strict=True)) for vs in votes]
    return {r["doc_id"] for r, m, x in zip(rows, measured, logit, strict=True) if m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"] and x >= 0}


def near(rows):
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return set(label.values())


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    assert all(s[3] == COLUMNS for s in stages[:-1])


def test_quality(stages):
    _, before, after, _ = stages[0]
    assert {r["doc_id"] for r in after} == quality(before)


def test_exact(stages):
    _, before, after, _ = stages[1]
    last = {}
    for r in before:
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    assert sorted(r["doc_id"] for r in after) == sorted(last.values())


def test_near(stages):
    _, before, after, _ = stages[2]
    assert {r["doc_id"] for r in after} == near(before)


def test_mixing(stages):
    _, before, after, _ = stages[3]
    times = Counter(r["doc_id"] for r in after)
    size, taken, most = Counter(), Counter(), Counter()
    for r in before:
        n = len(r["text"].encode().split())
        size[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
        most[r["source"]] = max(n, most[r["source"]])
    assert max(times.values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= sum(most.values())


def test_packing(stages):
    _, before, after, _ = stages[4]
    times = Counter(r["doc_id"] for r in before)
    ids = {r["doc_id"]: packing.token_ids(VOCABULARY, r["text"], 2) for r in before}
    pieces = defaultdict(Counter)
    for r in after:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]][r["start"], r["length"]] += 1
    for i, n in times.items():
        assert pieces[i] == {p: n for p in packing.cut(len(ids[i]), 1024)}
    used = Counter()
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024
    assert len(used) <= 1.02 * sum(used.values()) / 1024 + 2


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == len(stages[4][2])
