"""Flow-health analytics on Spark: measurement series, baselines, labels, evaluation and live jobs."""
