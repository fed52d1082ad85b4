"""Named sources of text rows."""
