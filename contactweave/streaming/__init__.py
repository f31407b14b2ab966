"""Pairs that arrive in files, batch by batch."""
