"""Logical plans: the ordered list of literal replacements and checks on it."""
