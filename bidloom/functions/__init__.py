"""functions of bidloom."""
