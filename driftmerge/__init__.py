"""driftmerge: replica-reconciliation analytics expressed as Spark DataFrame, SQL and streaming plans."""
