"""What a run does: fingerprints, actions, reconciliation, state."""
