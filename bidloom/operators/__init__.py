"""operators of bidloom."""
