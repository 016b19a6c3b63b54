"""Readers and writers: repository snapshots, BI exports, tickets, the stored index."""
