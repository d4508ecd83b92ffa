"""Training-data operators: text quality, deduplication, decontamination, privacy, tokenisation.

Each module holds one operator with a general DataFrame interface; ``queries`` binds
them to the test tables. Nothing outside this package imports it.
"""
