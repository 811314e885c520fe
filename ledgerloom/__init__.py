"""Spark-native ledger analytics: sources, functions, operators, plans and streaming."""
