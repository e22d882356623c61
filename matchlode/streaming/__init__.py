"""Scoring of unbounded input."""
