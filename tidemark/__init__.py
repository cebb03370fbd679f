"""Tidemark: sales and workforce analytics written as PySpark DataFrame transforms."""
