"""retenta."""
