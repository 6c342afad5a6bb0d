"""Lodestone: a PySpark-native engine for preference, corpus and evaluation tables."""
