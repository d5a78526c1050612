"""Planning helpers: fixpoint loops and the pattern compiler."""
