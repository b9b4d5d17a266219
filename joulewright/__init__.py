"""Joulewright: building-energy analytics as Spark DataFrame operators."""
