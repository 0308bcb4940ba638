"""Readers, writers, digests and unions."""
