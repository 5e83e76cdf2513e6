"""Tables and model views."""
