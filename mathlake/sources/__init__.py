"""Readers and writers: tables, text, manifests, archives, Markdown images."""
