"""Document retrieval and its evaluation as PySpark DataFrame transformations."""
