"""Evolutionary sparse learning on Spark: alignments in, sparse group models and scores out."""
