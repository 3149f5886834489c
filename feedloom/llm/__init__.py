"""Training-data operators: ten corpus operators and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
