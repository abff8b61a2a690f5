"""End-to-end plans: ingest, and the three reports."""
