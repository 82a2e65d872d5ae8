"""Column builders; every one stays inside Catalyst."""
