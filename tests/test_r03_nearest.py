import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("few", [3, 64])
def test_nearest_of_a_few_queries_at_a_time(spark, few, monkeypatch):
    """scores of a block are made for a few queries at a time."""
    from tessera import blocks

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = blocks.cosine_top(v, v.filter("vec_id % 10 = 0"), 4, few=few).orderBy("q_id", F.desc("score"), "vec_id").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = [(q, int(j), float(s[q, j])) for q in range(0, 200, 10) for j in sorted((j for j in range(200) if j != q), key=lambda j: (-s[q, j], j))[:4]]
    assert [(r.q_id, r.vec_id) for r in got] == [w[:2] for w in want]
    np.testing.assert_allclose([r.score for r in got], [w[2] for w in want])
