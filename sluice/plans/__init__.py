"""Entities bound to sources, whole loads, and reports over them."""
