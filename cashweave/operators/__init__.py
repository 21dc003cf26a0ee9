"""cashweave.operators."""
