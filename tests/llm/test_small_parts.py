"""op10 where the probed parts hold fewer vectors than asked for."""

import collections

import numpy as np

from pivotscore.llm import op10_ann


def test_queries_of_small_parts_get_whole_results(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 20
    x = centres[rng.integers(0, 40, 400)] + rng.normal(size=(400, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.Counter(r.query_id for r in op10_ann.search(df, df, aim=0.5).collect())
    assert got == {k: 10 for k in range(400)}
    got = collections.Counter(r.query_id for r in op10_ann.search(df, df.filter("vec_id < 20"), k=150, aim=0.5).collect())
    assert got == {k: 150 for k in range(20)}
