"""What the fits sample and how small shared steps end."""

import pytest

from quaymark.llm.common import labelled_sample
from quaymark.llm.ngram_join import components


def test_sample_is_taken_from_the_given_documents(spark):
    docs = spark.createDataFrame([(i,) for i in (3, 5, 5, 8)], "doc_id long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 4).collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(3, 1), (5, 1), (8, 0)]


def test_components_that_do_not_settle_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    assert {(r["node"], r["comp"]) for r in components(links).collect()} == {(i, 0) for i in range(7)}
    with pytest.raises(RuntimeError):
        components(links, 1)
