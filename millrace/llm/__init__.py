"""Training-data operators: ten corpus-scale steps and the queries that apply them."""
