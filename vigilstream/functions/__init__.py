"""Column functions: addresses, names, keys, times, strings."""
