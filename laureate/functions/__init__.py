"""Column expressions: text keys, labels and rounded numbers."""
