"""Contracts, spines, generators, adapters and catalog storage."""
