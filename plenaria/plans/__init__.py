"""Plans of the meeting-record engine."""
