"""Commands, and the catalogue of named queries with their SQL."""
