"""Training-data operators: dedup, decontamination, filtering, extraction and encoding of text corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds
its queries only when it is present.
"""
