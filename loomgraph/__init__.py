"""Property-graph analytics and dataset engineering as Spark jobs."""
