"""Readers for landed crawl output and the wiki-shaped views of the benchmark tables."""
