"""Queries by area: operators bound to tables, each with its SQL."""
