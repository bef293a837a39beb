"""Time-stamped video captions on Spark: preparation, checks, detection and evaluation."""
