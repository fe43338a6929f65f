"""auditlake: source-code audit analytics on PySpark."""
