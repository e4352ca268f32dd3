"""The upload trigger as a stream."""
