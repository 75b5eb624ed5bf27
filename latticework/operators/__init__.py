"""Metrics, the base cuboid, the cube, roll-ups over time and their final form, as DataFrame plans."""
