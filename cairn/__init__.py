"""Solid-archive analytics as DataFrame plans: manifests, dedup, packing, containers, reports."""

__version__ = "0.1.0"
