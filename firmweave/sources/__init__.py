"""Readers and writers for feeds, register files, filings and table snapshots."""
