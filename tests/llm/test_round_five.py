"""What the check of the third round found."""

from __future__ import annotations

import random

from tablewright.llm import shingle_join


def test_texts_that_share_less_than_three_quarters_are_never_paired(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    passage = [word() for _ in range(160)]
    rows = [(k, " ".join([*passage, *[word() for _ in range(100)]])) for k in range(30)]
    base = [word() for _ in range(200)]
    rows += [(100 + k, " ".join([*base[: 60 * k], word(), *base[60 * k :]])) for k in range(4)]
    met = []
    pairs = shingle_join.pairs_apart
    monkeypatch.setattr(shingle_join, "pairs_apart", lambda members: met.append(members.where("n > 250").count()) or pairs(members))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in shingle_join.document_components(docs).collect()}
    assert got == {k: min(k, 100) for k, _ in rows}
    assert met == [0]
