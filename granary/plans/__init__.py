"""Queries over the generated tables: one for each operator family, with the SQL that says the same."""
