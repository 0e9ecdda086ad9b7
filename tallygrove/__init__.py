"""Spark-first entity resolution and authority-data curation."""
