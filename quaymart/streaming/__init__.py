"""Streaming forms of the daily item roll-up and the session roll-up."""
