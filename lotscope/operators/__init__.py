"""The analyses: each takes a workspace and returns a DataFrame."""
