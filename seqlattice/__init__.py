"""Spark DataFrame operators for sequencing-derived tables."""

from seqlattice.session import build_session, checkpoint_folder, materialize, release

__all__ = ["build_session", "checkpoint_folder", "materialize", "release"]
