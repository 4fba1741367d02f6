"""A PySpark analytics engine for literature and evidence records."""
