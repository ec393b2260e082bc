"""Plan-level helpers: shared storage, package shipping, range ordering."""
