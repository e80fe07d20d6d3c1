"""Operators for preparing large text collections; nothing outside this subpackage imports it."""
