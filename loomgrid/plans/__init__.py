"""Ready-made queries over the engine's operators."""
