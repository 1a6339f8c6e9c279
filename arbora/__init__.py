"""Urban-tree analytics as PySpark DataFrame operators."""
