"""Landed tables, cleaning of raw exports and the panel derived from the driver tables."""
