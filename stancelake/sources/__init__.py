"""Readers and the clean-up steps that belong to them."""
