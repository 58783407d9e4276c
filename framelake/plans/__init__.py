"""Bindings of the sample tables and the queries registered for them."""
