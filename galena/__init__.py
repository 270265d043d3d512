"""Galena: an evidence-retrieval and corpus-preparation engine written on Spark DataFrames."""
