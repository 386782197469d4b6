"""Operators over formulas, candidates, documents and attempts."""
