"""Training-data operators: independent of the tile engine, which never imports this subpackage."""
