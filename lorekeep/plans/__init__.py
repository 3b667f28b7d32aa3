"""Plan pieces that several operators share: shared scratch tables and connected components."""
