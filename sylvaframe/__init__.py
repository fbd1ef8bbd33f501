"""Cluster-tree analytics and corpus preparation on PySpark DataFrames."""
