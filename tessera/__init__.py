"""Tessera: a PySpark-native analytics engine for scored and embedded media catalogs."""
