"""Logical layout: the class model, its evolution, and index predicates."""
