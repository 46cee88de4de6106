"""plans of bidloom."""
