"""Relational operators: tables in, tables out."""
