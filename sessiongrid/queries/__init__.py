"""Registered queries: every operator shown on the given tables, with its SQL where SQL can say it."""
