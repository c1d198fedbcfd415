"""Registered queries over the given tables, with SQL for each that SQL can express."""
