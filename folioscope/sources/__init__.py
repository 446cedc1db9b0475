"""Readers and writers of packages, bundles and stored files."""
