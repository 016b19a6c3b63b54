"""Tickets as a stream, joined with the index."""
