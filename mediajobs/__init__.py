"""mediajobs: PySpark jobs for document and media collections."""
