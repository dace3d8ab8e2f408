"""Openings-schedule analytics as Spark DataFrame plans."""
