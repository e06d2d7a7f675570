"""Complete jobs composed from sources and operators."""
