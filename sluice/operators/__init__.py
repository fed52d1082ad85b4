"""Row and table operators."""
