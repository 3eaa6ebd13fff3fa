"""Shapes of the two aggregates. Lists of categories are sorted by key; pairs of columns
are listed as the upper triangle, row by row."""

from __future__ import annotations

ONE = "array<array<struct<key:int,value:double>>>"
TWO = "array<array<struct<key1:int,key2:int,value:double>>>"


def triple_type(names: str = "agg") -> str:
    return f"struct<N:bigint,lin_{names}:array<double>,quad_{names}:array<double>,lin_cat:{ONE},quad_num_cat:{ONE},quad_cat:{TWO}>"


def nb_type(names: str = "agg") -> str:
    return f"struct<N:bigint,lin_{names}:array<double>,quad_{names}:array<double>,lin_cat:{ONE}>"


def pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]
