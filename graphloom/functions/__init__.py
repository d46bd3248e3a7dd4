"""Part of graphloom; see the package docstring."""
