"""Text correction, rule mining and n-gram statistics as Spark jobs."""
