"""Sessions, tables, shared storage and row numbering."""
