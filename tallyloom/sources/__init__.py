"""Catalog of relations and the file formats they are read from."""
