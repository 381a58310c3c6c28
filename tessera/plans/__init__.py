"""Relations derived from the driver tables and the registered query catalog."""
