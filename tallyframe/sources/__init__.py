"""Readers, catalogues of tables and columns, pages of rows, grouped sinks."""
