"""Lets tests import the package and the entry module from the repository's top."""
