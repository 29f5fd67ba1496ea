"""Registered queries (fixtures wired to operators) and their DuckDB oracles."""
