"""End-to-end job plans composed from the operators."""
