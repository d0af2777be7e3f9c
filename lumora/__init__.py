"""Media analytics on PySpark: search, timelines, people, albums, duplicates, ingest and streams."""
