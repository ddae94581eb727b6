"""Flight-delay analytics expressed as PySpark DataFrame jobs."""
