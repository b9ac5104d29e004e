"""Bars over unbounded input."""
