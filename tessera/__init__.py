"""tessera: derived knowledge-graph analytics as Spark DataFrame jobs."""
