from pyspark.sql import functions as F


def test_names_of_one_pattern_make_no_pairs(spark):
    """F1: tables that are alike in their codes' pattern only were all paired before they were scored."""
    from tessera.operators import duplicates

    n = 60
    rows = [(i, f"table-{i}", f"supTable{1000 + i}", [f"k{i}"], [f"v{i}", f"w{i}"]) for i in range(n)]
    rows[1] = (1, "table-1", "supTable1001", ["k0"], ["v1", "w1"])
    p = spark.createDataFrame(rows, "table_ord long, table_id string, plain string, keys array<string>, vocabulary array<string>")
    p = p.withColumns({"plain": F.lower("plain"), "name_terms": F.array("plain")})
    p = p.withColumn("grams", duplicates.trigrams(F.col("plain")))
    found = {(r.table_a, r.table_b) for r in duplicates.candidate_pairs(duplicates.rarest(p)).collect()}
    assert found == {("table-0", "table-1")}
