"""Relational operators: joins, aggregates, ranking, sampling, graphs, gates."""
