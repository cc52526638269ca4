"""Column functions: everything here is an expression Catalyst can see, but for the markdown chunker."""
