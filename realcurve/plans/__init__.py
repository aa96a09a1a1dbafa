"""Composed plans over one data folder."""
