"""Readers and writers with explicit schemas, markup and search-result parsing."""
