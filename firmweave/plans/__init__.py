"""Registered queries, their input adapters and their SQL twins."""
