"""Sources and sinks: catalog tables, archived files, page texts, the web."""
