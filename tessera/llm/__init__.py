"""Operators for large text corpora: quality, dedup, decontamination, extraction, search, PII, packing."""
