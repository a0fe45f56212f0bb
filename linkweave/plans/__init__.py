"""Physical helpers: materialised intermediate tables and fix-point loops."""
