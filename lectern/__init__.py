"""Lectern: content analytics on PySpark."""
