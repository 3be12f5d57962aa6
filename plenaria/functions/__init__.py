"""Functions of the meeting-record engine."""
