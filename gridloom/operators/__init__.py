"""DataFrame operators on observation tables."""
