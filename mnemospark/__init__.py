"""A Spark-first engine for hybrid retrieval and graph analytics over project memory."""
