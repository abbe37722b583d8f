"""pointmill: point-cloud segmentation, scoring and bulk data processing on Spark DataFrames."""
