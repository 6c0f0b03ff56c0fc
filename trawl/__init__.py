"""A PySpark engine for searching and analysing the rows an application already has."""
