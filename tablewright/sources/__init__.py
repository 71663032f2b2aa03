"""Readers and writers: dumps, crawled pages, HTML tables, JSON collections."""
