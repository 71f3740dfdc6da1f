"""Metric views, snippets, ranking, pairing and result checking."""
