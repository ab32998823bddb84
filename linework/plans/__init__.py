"""Plan helpers: written intermediate tables and per-group numbering."""
