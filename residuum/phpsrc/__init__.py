"""Reading source files: tokens, a tolerant parser, and the facts that a file states."""
