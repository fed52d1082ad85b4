"""The same plans over files as they arrive."""
