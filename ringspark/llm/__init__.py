"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames, keeps the caller's columns (one that has the name of a result is
renamed to the next free name, ``mix`` to ``mix_1``), and never moves an unbounded group
into one task or onto the driver.
"""
