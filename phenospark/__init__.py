"""Spark-native analytics for genotype-to-phenotype tables and training-data corpora."""
