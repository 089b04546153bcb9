"""Readers: files, connector message logs, relational databases, sample data."""
