"""Relational operators: profiles, statistics, similarity, comparison, votes, rewards."""
