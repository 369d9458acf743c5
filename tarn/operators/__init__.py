"""Ranked-access operators as DataFrame plans."""
