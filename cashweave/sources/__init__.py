"""cashweave.sources."""
