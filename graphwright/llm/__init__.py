"""Training-data operators over a ``documents`` table (one module per operator)."""
