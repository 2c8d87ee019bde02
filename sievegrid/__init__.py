"""Sievegrid: hybrid retrieval, ranking and corpus analytics on PySpark."""
