"""Personal-data-flow analytics over relational facts, on PySpark."""
