"""Multi-operator jobs: batch scoring, training and validation."""
