"""Entity/attribute analytics on PySpark: an append-only command log, and everything derived from it."""
