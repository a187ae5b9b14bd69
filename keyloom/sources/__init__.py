"""Stores, manifests and dump files."""
