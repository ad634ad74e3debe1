"""Stateful operators over keyframes, as batch folds and as Structured Streaming."""
