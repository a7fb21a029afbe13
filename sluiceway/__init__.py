"""Flow analytics as reusable PySpark DataFrame operators and batch plans."""
