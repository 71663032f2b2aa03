"""Operators over collections of web tables, sentences and queries."""
