"""functions of the conversation analytics library."""
