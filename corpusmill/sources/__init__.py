"""Scans, readers and table sinks."""
