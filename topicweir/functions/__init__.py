"""Column functions: text cleaning, tokens, scores."""
