"""Streaming of the meeting-record engine."""
