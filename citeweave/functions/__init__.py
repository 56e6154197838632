"""Column expressions: text cleaning, keys, vectors, JSON coercion."""
