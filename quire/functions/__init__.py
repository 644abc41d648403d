"""Column functions: normalization, string features, geometry, pattern synthesis."""
