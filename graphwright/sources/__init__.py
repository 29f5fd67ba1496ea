"""Input tables, derived fixture tables and file readers."""
