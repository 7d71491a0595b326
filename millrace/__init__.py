"""Millrace: a relational query engine on Spark, with operators for corpora of training data."""
