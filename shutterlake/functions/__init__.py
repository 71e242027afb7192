"""Column expressions: paths, names, dates, coordinates, tags, vectors."""
