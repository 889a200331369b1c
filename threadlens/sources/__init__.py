"""Scans of conversation exports into raw messages."""
