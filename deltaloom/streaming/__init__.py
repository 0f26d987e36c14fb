"""Incremental runs over growing inputs."""
