"""Readers and writers of logs, and the logs derived from the shared tables."""
