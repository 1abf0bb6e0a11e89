"""Operators on the relations of archives."""
