"""Orrery: event fusion, analytics and corpus preparation as PySpark DataFrame operators."""
