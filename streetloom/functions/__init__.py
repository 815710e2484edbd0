"""Part of the streetloom engine."""
