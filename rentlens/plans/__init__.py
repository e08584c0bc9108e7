"""Whole jobs built from the operators: cleaning, training tables, market, pricing."""
