"""Column functions: text, query strings and identities."""
