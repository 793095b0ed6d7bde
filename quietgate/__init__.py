"""Spark jobs that find, govern and report on sensitive data in text tables."""
