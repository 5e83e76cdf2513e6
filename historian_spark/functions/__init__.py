"""Naming rules, payload codecs and time buckets as column expressions."""
