"""Reports from collected results: pure functions over a few hundred rows on the driver."""
