"""Readers and extractors: files to documents, sections and chunks."""
