"""The manifest of a table and the plans that change it."""
