"""Queries over the given tables: bindings of the operators, and SQL that answers the same."""
