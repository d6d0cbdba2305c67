"""genotiles: genomic signal analytics as Spark DataFrame operations."""
