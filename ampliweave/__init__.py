"""Spark-native analytics for barcoded amplicon reads and lineages."""
