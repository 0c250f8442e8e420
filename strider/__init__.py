"""Spark-first analytics over street networks, timetables, permits and events."""
