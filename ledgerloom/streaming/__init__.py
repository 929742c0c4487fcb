"""The ledgers and comparisons that also run over streams."""
