"""Column expressions: no DataFrame, no job, usable in batch and in streams."""
