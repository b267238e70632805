"""Column functions: wire decoding, age lists and labels."""
