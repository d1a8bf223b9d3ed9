"""Reading source trees, manifests and documentation; parsing source files into symbols and references."""
