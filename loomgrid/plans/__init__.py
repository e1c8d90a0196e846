"""Registered queries: the operators bound to tables, each with equal SQL where SQL can say it."""
