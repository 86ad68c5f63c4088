"""Utility-bill audit as Spark DataFrame operators."""
