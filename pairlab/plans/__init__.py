"""Compositions of operators: the flagship acquisition query, the round loop, experiment
grids, and the catalog of registered queries with their SQL twins."""
