"""Readers and writers. Every reader has an explicit schema."""
