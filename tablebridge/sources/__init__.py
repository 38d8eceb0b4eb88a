"""Sources, sinks and catalog relations."""
