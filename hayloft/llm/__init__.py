"""Operators for building training data: mixing, filtering, scoring, joining, formatting and packing texts."""
