"""Column expressions: paths, lanes, codecs, formatting."""
