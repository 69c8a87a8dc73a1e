"""Readers of the pages of single site families: each gives the blocks of its pages from element rows."""
