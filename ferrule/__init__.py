"""Spark-native analytics over descriptor tables, fingerprints, molecules and text corpora."""
