"""Operators that prepare web text for training; nothing outside this subpackage imports it."""
