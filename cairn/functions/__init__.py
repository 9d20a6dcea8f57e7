"""Spark-native building blocks of cairn."""
