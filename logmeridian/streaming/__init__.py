"""Operators over arriving events."""
