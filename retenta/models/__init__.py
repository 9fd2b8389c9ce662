"""Stored models."""
