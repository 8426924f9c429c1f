"""Strata: a PySpark-native engine for hierarchically labelled embeddings and corpora."""
