"""Boosted trees order held-out candidates; missing features count 0."""

import random

from sparkmoment.operators import ltr


def test_boosted_trees_on_held_out_rows(spark):
    r = random.Random(3)
    rows = [(i, a := r.random(), b := r.random(), 1 if a + 0.2 * b > 0.6 else 0) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, asr double, visual double, hit int")
    model = ltr.fit_boosted(df.filter("id < 400"), "id", "hit", rounds=5, most=300)
    got = ltr.predicted(model, df.filter("id >= 400")).collect()
    assert sum((x.probability > 0.5) == (x.hit == 1) for x in got) / len(got) > 0.9
    odd = spark.createDataFrame([(1, None, float("nan"), "x")], "id bigint, asr double, visual double, object string")
    assert [tuple(x[c] for c in ltr.FEATURES) for x in ltr.features(odd).collect()] == [(0.0,) * 6]
    assert 0 <= ltr.predicted(model, odd).first().probability <= 1
