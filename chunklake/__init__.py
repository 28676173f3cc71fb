"""chunklake: content deduplication, storage analytics and corpus preparation on Spark DataFrames."""
