"""Sources, sinks and what happens to rows on their way in and out."""
