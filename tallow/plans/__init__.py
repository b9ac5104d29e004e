"""Registered queries with their SQL, and the research plan."""
