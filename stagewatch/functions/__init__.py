"""stagewatch."""
