"""Multi-stage plans composed from the operators."""
