"""Candle tables from events, exchange files and random walks."""
