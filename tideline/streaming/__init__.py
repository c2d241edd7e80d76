"""The same bars from streams."""
