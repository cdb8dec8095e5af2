"""DataFrame operators of the tile engine."""
