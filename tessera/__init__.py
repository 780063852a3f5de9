"""Tessera: schema-metadata analytics and training-data preparation on Spark DataFrames."""
