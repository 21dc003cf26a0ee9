"""cashweave.streaming."""
