"""Sensor-file ingestion, categorization and reporting on PySpark."""
