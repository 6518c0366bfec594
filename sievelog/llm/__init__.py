"""Operators for text corpora: tokenising, cleaning, deduplication, decontamination and web archives."""
