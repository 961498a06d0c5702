"""End-to-end jobs: training, walk-forward evaluation, drift, batch forecast."""
