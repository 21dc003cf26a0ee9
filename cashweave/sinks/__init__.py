"""cashweave.sinks."""
