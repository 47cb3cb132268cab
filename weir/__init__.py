"""Set-based operators for batch and streaming tables, written for PySpark."""
