"""Kindred: entity resolution across catalogs, as composable Spark DataFrame operators."""
