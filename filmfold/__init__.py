"""Collaborative-filtering analytics as composable PySpark DataFrame operators."""
