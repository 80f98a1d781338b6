"""Training-data operators: ten large-corpus building blocks and their registered queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
