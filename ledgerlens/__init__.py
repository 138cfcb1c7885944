"""Invoice-document analytics as PySpark DataFrame jobs."""
