"""Operators on tables of counts, cells, genes and networks."""
