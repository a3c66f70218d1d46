"""tidewright: timed-sequence analytics on PySpark."""
