"""plans of the conversation analytics library."""
