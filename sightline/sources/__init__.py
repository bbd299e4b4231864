"""Readers and writers: observation exports, API pages, metric tables, catalog."""
