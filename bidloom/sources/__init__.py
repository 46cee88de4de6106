"""sources of bidloom."""
