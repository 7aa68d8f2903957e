"""Plans that several operators share."""
