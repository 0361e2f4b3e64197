"""Queries over model and gold spans cut the texts once."""

import pytest

from spanloom.plans import inputs, registry

SMALL = "/root/testdata/sf0.001"


def cuts(spark, monkeypatch, name):
    calls, own = [], inputs.token_rows
    monkeypatch.setattr(inputs, "token_rows", lambda *a, **b: calls.append(1) or own(*a, **b))
    registry.QUERIES[name](spark, SMALL)
    return len(calls)


def test_align_models_cuts_once(spark, monkeypatch):
    assert cuts(spark, monkeypatch, "align_models") == 1


def test_holdout_cuts_once(spark, monkeypatch):
    assert cuts(spark, monkeypatch, "holdout_by_status") == 1


@pytest.mark.parametrize("name", ["mode_comparison", "full_report"])
def test_reports_share_spans_and_terms(spark, monkeypatch, name):
    from spanloom.operators import resolve
    from spanloom.plans import queries_more, queries_resolve

    found, listed, dictionary, terms = [], [], resolve.dictionary_entities, inputs.terms
    monkeypatch.setattr(resolve, "dictionary_entities", lambda *a, **b: found.append(1) or dictionary(*a, **b))
    for part in (queries_more, queries_resolve):
        monkeypatch.setattr(part, "terms", lambda *a: listed.append(1) or terms(*a))
    assert cuts(spark, monkeypatch, name) == 1
    assert len(found) == len(listed) == 1
