"""Training-data operators: tokenisation, sharding, near-copies, leaks, quality, privacy and language-model scores.

Nothing else in the library imports this package; ``queries`` collects what it registers.
"""
