"""The store: an append-only log of events folded into current state, and a façade of tools."""
