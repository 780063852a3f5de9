from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_files_that_compress_well_are_not_broadcast_by_their_size(spark):
    """a catalog's file is small, its rows aren't."""
    from tessera.session import materialise
    from tessera.sources.synthetic import synthetic_catalog

    synthetic_catalog(spark, DATA)
    rows = spark.range(200_000).select((F.col("id") % 50).alias("k"), F.repeat(F.md5((F.col("id") % 5000).cast("string")), 10).alias("text"))
    small, other = materialise(rows), materialise(rows)
    plan = small.join(other, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
