"""Where snapshots come from and where results go."""
