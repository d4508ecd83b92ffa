"""Operators over note tables."""
