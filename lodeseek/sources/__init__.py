"""Corpora, indexes and reports on storage."""
