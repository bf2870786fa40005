"""Column functions: text forms, hashes, canonical values."""
