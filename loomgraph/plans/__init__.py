"""Named queries: registry, catalogue and their SQL equivalents."""
