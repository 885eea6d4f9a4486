"""Incremental runs of the keyed stores."""
