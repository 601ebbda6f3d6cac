"""Code-structure and text analytics expressed as DataFrame transformations."""
