"""Spark jobs for two-player card-game records: cleaning, card-subset graphs, null model."""
