"""streaming of bidloom."""
