"""Operators over training text. Nothing outside this folder imports it, save the driver entry."""
