"""Column functions; everything here stays inside Catalyst."""
