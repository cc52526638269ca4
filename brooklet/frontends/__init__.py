"""Front ends: JSON lines, HTTP, command line."""
