"""commentmill: clean, augment, scan, score and model tables of comments on Spark."""
