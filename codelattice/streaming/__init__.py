"""Incremental work on sources that grow."""
