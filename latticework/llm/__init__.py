"""Operators of a training-data pipeline over text, media, vectors and dialogue.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only if the subpackage is there.
"""
