"""Log intelligence on PySpark: parsing, buckets, analytics, look-back windows, models and mining."""
