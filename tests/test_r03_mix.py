import numpy as np
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_packing_keeps_the_order_that_was_mixed(spark, tmp_path):
    """what the mixing stage has written decides the order of the sequences."""
    import corpus_pipeline

    rows = [(i, f"text of number {i} " * 30, "en", "src0" if i % 3 else "src1", 1) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # another order than the mix has: packing follows it
    d.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(f"{tmp_path}/turned")
    got = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/turned"), DATA).orderBy("sequence_id", "offset").toPandas()
    assert set(got.doc_id) == set(range(300)) and got.length.sum() == got.groupby("doc_id").doc_tokens.first().sum()
    assert np.corrcoef(got.doc_id, range(len(got)))[0, 1] < -0.99  # but for pieces that fill sequences up
