"""Bars, features, labels, motifs, evaluation and execution over candles."""
