"""Sources of the meeting-record engine."""
