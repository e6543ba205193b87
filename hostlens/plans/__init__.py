"""Registered queries over the sample feed and their SQL counterparts."""
