"""Operators that prepare training data: overlap, budgets, pieces, splits, samples, encoding, mixtures, cuts."""
