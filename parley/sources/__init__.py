"""sources of the conversation analytics library."""
