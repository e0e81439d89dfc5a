"""Subscriber retention analytics as PySpark DataFrame transforms."""
