"""Training-data operators: archives, de-duplication, classifiers, tokenisation and sharding.

Nothing outside this subpackage imports it.
"""
