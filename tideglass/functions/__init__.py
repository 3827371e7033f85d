"""Function signatures and IEEE-safe column arithmetic."""
