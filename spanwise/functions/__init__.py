"""Column functions: geometry over arrays, scores, set measures."""
