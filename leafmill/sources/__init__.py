"""Landed listings and files as canonical tables."""
