"""Building blocks for jobs that must stay even and restartable at any size."""
