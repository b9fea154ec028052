"""Edge changes as a stream."""
