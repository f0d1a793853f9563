"""Keyword, SQL-result and job-progress analytics as plain PySpark DataFrame functions."""
