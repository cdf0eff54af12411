"""Lexical analytics as Spark DataFrame and SQL operations."""
