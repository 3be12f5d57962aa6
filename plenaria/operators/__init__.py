"""Operators of the meeting-record engine."""
