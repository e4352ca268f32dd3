"""Column functions: text, names, amounts, similarity, geometry, and the controlled vocabularies."""
