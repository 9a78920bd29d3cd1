"""Column -> Column building blocks; all native expressions except full entity decoding."""
