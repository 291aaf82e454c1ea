"""Operators for training-data pipelines over ``documents`` and ``pages``; nothing outside this folder imports them."""
