"""Readers of landed data and the keyed stores."""
