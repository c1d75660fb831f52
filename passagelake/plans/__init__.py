"""Plans: what a sync would do, and whether it may."""
