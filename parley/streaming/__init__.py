"""streaming of the conversation analytics library."""
