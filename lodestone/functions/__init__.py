"""Scalar functions: strings, codecs, HTTP predicates and cryptography."""
