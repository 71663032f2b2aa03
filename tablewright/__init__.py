"""Structured-knowledge work over web pages and tables, on Spark."""
