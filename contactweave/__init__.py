"""Spark-native analytics for genomic contact pairs."""
