"""seekgrain: hybrid retrieval and evidence analytics written as Spark DataFrame jobs."""
