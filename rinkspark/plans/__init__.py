"""Planning helpers: staging, checked broadcasts, skew handling."""
