"""Operators that prepare page texts for training language models; nothing outside imports this."""
