"""Queries of the catalogue, by subject, with their SQL twins."""
