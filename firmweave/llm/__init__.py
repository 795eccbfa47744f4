"""Operators on text corpora: filters, duplicates, search, language model, tokens. Nothing outside imports this package."""
