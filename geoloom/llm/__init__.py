"""Training-data pipeline operators.

Each module holds one operator with its own general interface; ``queries``
binds the operators to the ``documents`` tables.  Nothing outside this
subpackage imports it.
"""
