"""Column functions with the library's cell semantics."""
