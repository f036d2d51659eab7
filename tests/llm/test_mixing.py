"""Targets that contradict themselves, and the mix at full size."""

import pytest

from lorebase.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def test_a_source_listed_twice_is_an_error(spark):
    with pytest.raises(ValueError, match="twice"):
        mixing.read_targets(spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 2)], TARGETS))


def test_full_size_keeps_the_text(spark):
    docs = spark.createDataFrame([(i, "big", "word " * 20) for i in range(400)] + [(1000 + i, "tiny", "word " * 20) for i in range(4)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], TARGETS)
    full, exact = mixing.mix(docs, targets, total_tokens="listed_tokens"), mixing.mix(docs, targets)
    got = {r["source"]: r for r in mixing.shares(full, targets).collect()}
    assert full.count() >= 0.98 * 404 and got["tiny"]["n_copies"] == 8 and got["big"]["most_copies"] == 1
    assert exact.count() < 20
