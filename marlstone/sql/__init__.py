"""Lexer, syntax tree and parser."""
