"""Training-data operators: ten corpus-scale components and the queries that apply them."""
