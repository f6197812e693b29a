"""Scans: files and packets to flow rows."""
