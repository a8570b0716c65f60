"""A PySpark engine for document and table analytics."""
