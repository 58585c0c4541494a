"""Generators of particle tables, and their binding to stored ones."""
