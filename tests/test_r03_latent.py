import random

import numpy as np


def test_products_in_dense_blocks(spark):
    """a stretch holds ROWS texts at most, and its block is the matrix over the features used."""
    import pyarrow as pa

    from tessera.operators import latent

    rng = random.Random(3)
    whole = [[rng.randrange(50) for _ in range(rng.randrange(9))] for _ in range(300)]
    part = [[rng.randrange(50) for _ in range(rng.randrange(3))] for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in (whole, part)], ["whole", "part"])
    want = np.zeros((300, 50))
    for i in range(300):
        np.add.at(want[i], whole[i], 1.0)
        np.add.at(want[i], part[i], 0.7)
    got, at = np.zeros((300, 50)), 0
    for stored in latent.added_up(50)([batch]):
        for n, row, feature, weight in latent.entries_of(stored):
            used, block = latent.dense_block(n, row, feature, weight, 50)
            assert 0 < n <= latent.ROWS
            got[at : at + n, used] = block
            at += n
    assert at == 300
    np.testing.assert_allclose(got, want, atol=1e-12)
