"""Regional energy data on Spark: streets, networks, demands, technologies, model tables, results."""
