"""NumPy kernels for grouped maps: each works on one bounded group (an hour, a grid, a configuration, a restart)."""
