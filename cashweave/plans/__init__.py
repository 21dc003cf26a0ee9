"""cashweave.plans."""
