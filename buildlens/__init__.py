"""Build-fleet analytics on Spark: batch and streaming operators over fleet records."""
