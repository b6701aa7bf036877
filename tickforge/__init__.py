"""tickforge: market-microstructure analytics as Spark jobs."""
