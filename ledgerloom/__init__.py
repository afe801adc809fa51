"""ledgerloom: Spark jobs that ingest, clean, validate and audit expense records."""
