"""Set-similarity joins and supporting relational operators on PySpark."""
