"""Plans that put operators together: derived inputs and the engine."""
