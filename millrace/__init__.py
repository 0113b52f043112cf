"""millrace: a Spark-first toolkit for metric series, record exploration, page processing and classification."""
