"""The queries of the core, with their SQL."""
