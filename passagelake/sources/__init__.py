"""Sources: folders of notes, logs of records, configuration."""
