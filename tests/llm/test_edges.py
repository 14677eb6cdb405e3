"""Every operator on nulls, empty and very long texts, ties, repeats, clashing names and no rows at all."""

import pytest

from nestfold.llm import exact_dedup, lm_scoring, mixing, packing, pii, quality_rules, sharding, simhash, substring_dedup, token_counts
from nestfold.llm.queries import VOCABULARY

OPERATORS = {
    "token_counts": lambda d: token_counts.token_counts(d, VOCABULARY),
    "mix_sizes": mixing.mix_sizes,
    "substring_dedup": substring_dedup.substring_dedup,
    "score_quality": quality_rules.score_quality,
    "shard_documents": sharding.shard_documents,
    "exact_groups": exact_dedup.exact_groups,
    "lm_scores": lm_scoring.lm_scores,
    "near_classes": simhash.near_classes,
    "pii_spans": pii.pii_spans,
}
FILTERS = {"mix": mixing.mix, "quality_filter": quality_rules.quality_filter, "exact_dedup": exact_dedup.exact_dedup, "near_dedup": simhash.near_dedup, "redact": pii.redact}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, odd, odd_rows):
    got = [r["doc_id"] for r in OPERATORS[name](odd).select("doc_id").collect()]
    key = lambda i: (i is None, i or 0)
    assert sorted(got, key=key) == sorted((r[0] for r in odd_rows), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, none):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(name, odd, none):
    assert FILTERS[name](odd).columns == odd.columns
    assert FILTERS[name](none).collect() == []


def test_filters_choose_one(odd, odd_rows):
    texts = [r["text"] or "" for r in exact_dedup.exact_dedup(odd).collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in odd_rows})
    near = simhash.near_dedup(odd).collect()
    assert sum(r["doc_id"] in (1, 2, 3) for r in near) == 1
    assert sum(r["doc_id"] == 9 for r in near) == 1


def test_packing(odd, odd_rows, none):
    got = packing.pack_documents(odd, VOCABULARY).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in odd_rows}
    assert sum(r["length"] for r in got if r["doc_id"] == 9) == 2 * (len(packing.token_ids(VOCABULARY, "twice", 2)))
    assert packing.pack_documents(none, VOCABULARY).collect() == []
