"""News-diffusion analytics on PySpark: ingest, cleaning, duplicate families, events, publisher graphs."""
