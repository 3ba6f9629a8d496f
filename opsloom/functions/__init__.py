"""User-defined function registration."""
