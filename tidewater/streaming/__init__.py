"""The observation table over a stream."""
