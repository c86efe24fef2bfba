"""Change events as streams."""
