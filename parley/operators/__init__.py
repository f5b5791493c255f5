"""operators of the conversation analytics library."""
