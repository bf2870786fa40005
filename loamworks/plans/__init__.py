"""Registered queries: the operators applied to the shared tables, each with the SQL that says what it returns."""
