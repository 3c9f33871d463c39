"""Curation, statistics and evaluation of labelled comment corpora on Spark DataFrames."""
