"""The jobs: operators composed from landed tables to result tables."""
