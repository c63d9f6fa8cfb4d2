"""Compositions of operators over whole tables."""
