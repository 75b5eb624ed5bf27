"""Inputs: path templates, the completeness check, readers by format, configured lists."""
