"""Scans, sinks and table contracts."""
