"""Column-expression helpers and fixed lookup values."""
