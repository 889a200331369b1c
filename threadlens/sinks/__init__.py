"""Renderers: compact text, Markdown, CSV, JSON and HTML transcripts."""
