"""Near copies of one text are not joined with all the groups that their slices form."""

from __future__ import annotations

import random

import pytest

simhash = pytest.importorskip("trustloom.llm.simhash")


def test_groups_of_connected_documents_are_dropped(spark, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(150):
        text = list(words)
        for at in r.sample(range(300), 3):
            text[at] = f"w{i}x{at}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join("".join(r.choice("mnopqrst") for _ in range(6)) for _ in range(60))) for i in range(20)]
    made, before = {}, simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, label: made.setdefault(label, before(df, label)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(150)} == {0} and all(found[1000 + i] == 1000 + i for i in range(20))
    # 150 documents have 2,850 values in all
    assert made["near-met"].count() < 300
