"""Sources and sinks: mixed files to one text table with a quarantine, and audio to files."""
