"""Sources and sinks: file trees, block containers, archives of other tools."""
