"""Operators for preparing training text at scale; see ``queries.py`` for how they are registered."""
