"""Late-interaction retrieval on Spark: token vectors in DataFrames, exact and quantised scoring, ranking evaluation."""
