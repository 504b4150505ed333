"""Complete jobs: the named queries over the given tables, and their SQL checks."""
