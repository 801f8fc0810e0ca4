"""Operators for preparing large text corpora: language, duplicates, quality, mixing, tokens, archives."""
