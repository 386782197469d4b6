"""Attempts and edits that arrive as streams."""
