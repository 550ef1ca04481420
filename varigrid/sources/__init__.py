"""Readers and writers of sequencing files."""
