"""Column functions: guards, clocks, pricing, canonical content."""
