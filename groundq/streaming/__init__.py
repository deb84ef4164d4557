"""The trace log as a stream."""
