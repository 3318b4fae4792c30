"""Corpus annotation analytics on Spark: documents, codebooks, coded spans, coders."""
