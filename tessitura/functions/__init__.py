"""Column functions: text folding, title cleaning, search scores, times."""
