"""Column expressions: text, SQL text, names, YAML and salts."""
