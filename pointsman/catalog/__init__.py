"""Registered queries: every operator on the given tables, each with its SQL where SQL can say it."""
