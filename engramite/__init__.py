"""Retrieval and memory analytics as DataFrame operators on Apache Spark."""
