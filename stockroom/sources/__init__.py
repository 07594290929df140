"""Readers: test-table fixtures, CSV folders, accounting XML, file hashes."""
