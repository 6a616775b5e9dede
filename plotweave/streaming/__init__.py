"""Incremental import and stateful folds."""
