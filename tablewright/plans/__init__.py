"""Target schemas, column resolution and the whole-table jobs built from the operators."""
