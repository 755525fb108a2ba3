"""Stage compositions: features, training, evaluation, prediction, review."""
