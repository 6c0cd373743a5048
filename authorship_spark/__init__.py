"""Corpus-scale authorship comparison and corpus preparation on Spark."""
