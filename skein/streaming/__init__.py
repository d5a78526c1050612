"""Edge streams folded into sketches of fixed size."""
