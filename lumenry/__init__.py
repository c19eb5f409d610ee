"""Evidence retrieval, answer auditing and corpus preparation as Spark jobs."""
