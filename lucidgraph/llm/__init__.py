"""Operators for preparing training corpora. Nothing else in lucidgraph imports this package."""
