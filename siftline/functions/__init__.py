"""Column expressions: text rules, paths, severities, keys."""
