"""Sources, sinks and parsers of semi-structured text."""
