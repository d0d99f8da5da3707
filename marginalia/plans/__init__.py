"""Query trees: parsing, validation, flattening."""
