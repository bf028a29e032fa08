"""The registered queries, with equivalent SQL."""
