"""Scans, sinks, reshaping and assembly of result tables."""
