"""Document retrieval and decision analytics as DataFrame plans."""
