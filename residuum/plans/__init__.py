"""Shared plan helpers: tables, sessions and materialised intermediates."""
