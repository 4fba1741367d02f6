"""Training-data operators: dedup, packing, language ID, media, tokenizers, HTML.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
