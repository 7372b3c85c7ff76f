"""Paired-evaluation analytics as Spark DataFrame plans."""
