"""Run checkpoints, result caches and retention."""
