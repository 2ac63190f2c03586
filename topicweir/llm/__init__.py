"""Operators for preparing training corpora, one module each; `queries` registers them."""
