"""Graph operators: patterns, traversal, projection and writes, emitted as DataFrame plans."""
