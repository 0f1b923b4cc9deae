"""Readers and writers for corpora, findings and the learning store."""
