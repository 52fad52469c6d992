"""From query text to a syntax tree."""
