"""Tillage: country-level food-risk analytics as Spark DataFrame jobs."""
