"""Stages and how they are stored and chained."""
