"""HTML trees: tokens, tree construction, serialisation."""
