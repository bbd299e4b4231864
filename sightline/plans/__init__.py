"""Jobs composed from operators: metric build, chart series, ingest, audit."""
