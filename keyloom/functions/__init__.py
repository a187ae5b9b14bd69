"""Column functions: strings, bits, expiry, lists, sets and codecs."""
