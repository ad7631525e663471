"""Document-to-insight analytics as Spark jobs: DataFrames in, DataFrames out."""
