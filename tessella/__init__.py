"""Sample-level analytics on Spark: quality control, compositions, distances, joins, statistics and trajectories as DataFrame plans."""
