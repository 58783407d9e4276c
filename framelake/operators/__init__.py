"""DataFrame operators, one module per table family."""
