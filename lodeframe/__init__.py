"""A PySpark engine for event lists, projections and training data."""
