"""Readers and writers: documents, corpora, rules and reports."""
