"""Registered queries: operators bound to the relational tables, each with its SQL twin."""
