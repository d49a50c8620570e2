"""Gridded space-time panels on Spark: build, check, rank, score and publish."""
