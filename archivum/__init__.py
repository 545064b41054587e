"""Archivum: search, aggregates and whole-archive analytics over message archives, as DataFrame jobs."""
