"""Column functions: URL, hashing, text and record codecs."""
