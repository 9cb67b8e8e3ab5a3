"""DataFrame -> DataFrame operators. Every function is pure and lazy."""
