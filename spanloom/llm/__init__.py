"""Operators for the training data of text models. Nothing outside this subpackage imports it."""
