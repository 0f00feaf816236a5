"""Composite plans: what a user calls for a whole task."""
