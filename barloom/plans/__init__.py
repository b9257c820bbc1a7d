"""End-to-end pipelines, the views over the bench tables and the registered queries with their SQL checks."""
