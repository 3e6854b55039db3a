"""Opinion dynamics in time-stamped text, as DataFrame expressions and set-based plans."""
