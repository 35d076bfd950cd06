"""Analytics on ranked offer sequences, as PySpark DataFrame operators."""
