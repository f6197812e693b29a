"""Training-data operators: one module per operator, each DataFrame in, DataFrame out.

Nothing outside this subpackage imports it.
"""
