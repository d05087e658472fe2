"""The learned decision list on labels that it has not seen."""

import pytest
from pyspark.sql import functions as F

from loomstone.llm import rules
from loomstone.session import load


def outcome(spark, sf):
    """(rules, toxic rows, those rejected, good rows, those lost but by the base rules): learned on four fifths of the labels, measured on the rest."""
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    most = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) != 0
    terms, learned = rules.learn(docs, labels.filter(most))
    seen = labels.filter(~most).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rules.apply_rules(docs.join(seen, "doc_id"), terms, learned)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    counts = [F.col("toxic") == 1, (F.col("toxic") == 1) & ~F.col("kept"), good, good & ~F.col("base_failed") & ~F.col("kept")]
    return learned, *rows.agg(*[F.count_if(c) for c in counts]).first()


@pytest.mark.parametrize("sf, recall", [("sf0.01", 0.5), ("sf0.1", 0.8)])
def test_list_holds_on_unseen_labels(spark, sf, recall):
    learned, toxic, caught, good, lost = outcome(spark, f"/root/testdata/{sf}")
    print(sf, [" & ".join(map(str, r)) for r in learned], toxic, caught, good, lost)
    assert learned and caught >= recall * toxic and lost < 0.02 * good


def test_search_goes_on_after_a_refused_rule():
    """The feature with the highest gain on the growing rows fails on the others; the second one holds."""
    rows, held = [], []
    for i in range(300):
        bad, own = i % 3 == 0, i % 4 == 0
        x = [0.0] * len(rules.FEATURES)
        x[0] = 1.0 if (bad if not own else i % 2 == 0) else 0.0
        x[1] = 1.0 if bad and i % 5 else 0.0
        rows.append((x, bad))
        held.append(own)
    learned = rules.learn_list(rows, held=held)
    assert [str(t) for t in learned[0]] == [f"{rules.FEATURES[1]} >= 0.5"]


def test_bound_of_a_share():
    assert rules.least_share(0, 0) == 0 and rules.least_share(8, 8) < rules.BOUND < rules.least_share(9, 9)
    assert abs(rules.least_share(90, 100) - 0.8388) < 1e-3
