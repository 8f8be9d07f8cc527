"""DataFrame operators over manifests, blocks and entries."""
