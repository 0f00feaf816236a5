"""Masks, grok patterns, mapping tables, parser specs, detection rules."""
