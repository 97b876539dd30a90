"""Documents to node tables."""
