"""DataFrame operators: each takes frames and names, and returns a frame."""
