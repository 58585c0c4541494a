"""Relational operators over particle tables; every one takes and returns an explicit slot."""
