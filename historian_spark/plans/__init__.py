"""Bounds, filters and aggregate plans: plain data compiled to columns."""
