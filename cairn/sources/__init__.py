"""File-tree and container sources and sinks."""
