"""Corpus-scale extractive text analytics on PySpark."""
