"""Uptake and gap analytics as Spark DataFrame transformations."""
