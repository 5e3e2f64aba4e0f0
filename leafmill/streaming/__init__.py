"""The increment as a stream."""
