"""Column functions: partition transforms, key hashes, bloom filters, schema conversion."""
